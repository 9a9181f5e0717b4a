from weft.catalog import compare_queries, data_queries, eval_queries, graph_queries, run_queries, vector_queries

SECTIONS = [m.section for m in (data_queries, graph_queries, vector_queries, eval_queries, compare_queries, run_queries)]
