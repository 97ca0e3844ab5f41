"""Queries over all rows, on small tables where a cut would show."""

import duckdb
from lodestrata.plans import registry


def tables(d, **rows):
    """One Parquet file for each name: (columns, rows)."""
    con = duckdb.connect()
    for name, (cols, values) in rows.items():
        con.execute(f"CREATE TABLE {name} ({cols})")
        con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(values[0]))})", values)
        con.execute(f"COPY {name} TO '{d}/{name}.parquet'")
    return str(d)


def run(spark, name, d):
    return [tuple(r) for r in registry.QUERIES[name](spark, d).collect()]


def test_overlay_takes_terms_of_all_documents(spark, tmp_path):
    d = tables(tmp_path, part=("p_name VARCHAR", [["copper anvil"]]), documents=("doc_id BIGINT, text VARCHAR", [[3, "purple lantern"], [700, "copper harbour"]]))
    assert dict(run(spark, "split_overlay", d)) == {"copper": "both", "anvil": "entity", "purple": "term", "lantern": "term", "harbour": "term"}


def test_diversity_compares_whole_texts(spark, tmp_path):
    head, tails = " ".join(f"head{i}" for i in range(260)), [" ".join(f"tail{k}n{i}" for i in range(900)) for k in range(2)]
    docs = [[1, f"{head} {tails[0]}", "a"], [2, f"{head} {tails[0]}", "b"], [3, f"{head} {tails[1]}", "c"], [4, "other words", "d"]]
    d = tables(tmp_path, documents=("doc_id BIGINT, text VARCHAR, source VARCHAR", docs), benchmark=("item_id BIGINT, text VARCHAR", [[1, head]]))
    seats = {r.seat: r.doc_id for r in registry.QUERIES["mmr_select"](spark, d).collect()}
    assert seats == {1: 1, 2: 3, 3: 2}


def test_searches_take_their_whole_query_set(spark, tmp_path):
    phrase = "amber bridge canal dune ember"
    d = tables(
        tmp_path,
        benchmark=("item_id BIGINT, text VARCHAR", [[i, f"{phrase} q{chr(97 + i)}"] for i in (0, 7, 20)]),
        documents=("doc_id BIGINT, text VARCHAR", [[i, f"so {phrase} q{chr(97 + i)} it is"] for i in (0, 7, 20)]),
        conversations=("conv_id BIGINT", [[3], [50], [200]]),
        part=("p_partkey BIGINT, p_size BIGINT, p_name VARCHAR", [[1, 4, "small bolt"]]),
        orders=("o_orderkey BIGINT, o_custkey BIGINT", [[1, 3], [2, 50], [3, 150]]),
        lineitem=("l_orderkey BIGINT, l_linenumber BIGINT, l_partkey BIGINT, l_quantity DOUBLE", [[o, i, p, 1.0] for o in (1, 2, 3) for i, p in enumerate((3, 50, 100))]),
    )
    for name in ("lane_grounding", "lexical_regex_score"):
        got = {(r.item_id, r.doc_id) for r in registry.QUERIES[name](spark, d).collect()}
        assert {(i, i) for i in (0, 7, 20)} <= got
    assert {r.conv_id for r in registry.QUERIES["query_entities"](spark, d).collect()} == {50, 200}
    assert {(r.doc, r.other) for r in registry.QUERIES["book_bridges"](spark, d).collect()} == {(50, 3), (50, 150), (150, 3), (150, 50)}
    assert {r.l_partkey for r in registry.QUERIES["facts_capped_per_entity"](spark, d).collect()} == {50, 100}
