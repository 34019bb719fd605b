from rankloom.llm import line_dedup, registry


def test_sql_is_text_of_registered_queries():
    sql = registry.oracle_sql()
    assert set(sql) <= set(registry.queries()) and all(isinstance(s, str) for s in sql.values())
    assert sql["op3_line_dedup"] == line_dedup.SQL and "op1_simhash_near_dedup" not in sql
