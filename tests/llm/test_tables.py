"""URLs and vectors against plain Python, odd inputs included; the pipeline."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakewarden.llm import common, neardup_vectors, permutations, urls
from tests.llm.conftest import with_clashes


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200, 260)] + [(1000, i) for i in range(1001, 1100)] + [(5, 5), (7, 6), (6, 7)]
    got = {r.id: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 200 for i in range(200, 261)}, **{i: 1000 for i in range(1000, 1100)}, 6: 6, 7: 6}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def page(link="", refresh=""):
    link = f'<link rel="canonical" href="{link}">' if link else ""
    refresh = f'<meta http-equiv="refresh" content="0; url={refresh}">' if refresh else ""
    return f"<html><head>{link}{refresh}</head></html>"


def test_verdicts_spread(spark):
    rows = [
        (1, "http://a.net/1", page("https://x.com/de/bad")),
        (2, "http://b.net/2", page("", "http://a.net/1/")),
        (3, "http://c.net/3?q#f", page("http://www.c.net/4")),
        (4, "https://C.net/4", page("http://x.com/fr/good")),
        (5, "http://d.net/5", page("http://x.com/de/other", "http://x.com/fr/well")),
        (6, "http://m.example.org/es/1", page()),
        (7, "http://m.example.org/en/17", page("http://x.com/fr/good")),
        (8, "http://example.org", page()),
        (9, "no url", page("http://x.com/de/bad")),
        (10, None, None),
        (11, "http://e.net/11", None),
        (12, "http://f.net/dir/page", page("other")),
        (13, "http://f.net/dir/other", page("/../x", "//x.com/de/y")),
        (13, "http://f.net/dir/other", page("/../x", "//x.com/de/y")),
    ]
    frame = with_clashes(rows, "page_id long, url string, html string", spark)
    got = urls.filter_urls(frame).collect()
    assert len(got) == len(rows)
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}
    assert [found[i][3] for i in range(1, 14)] == ["block", "block", "allow", "allow", "allow", "block", "block", "allow", "allow", "allow", "allow", "block", "block"]
    assert found[3][:2] == ("c.net", "/3") and found[4][0] == "c.net"
    assert [found[i][2] for i in (6, 7, 8, 9)] == ["example.org/es/", "example.org/en/1", None, None]
    assert found[9][:2] == found[10][:2] == ("", "")
    assert urls.filter_urls(frame.limit(0)).count() == 0


def test_addresses_keep_their_query_and_are_resolved(spark):
    rows = [
        (1, "http://a.net/watch?v=1", page("http://x.com/de/bad")),
        (2, "http://a.net/watch?v=2", page()),
        (3, "http://www.a.net/watch?v=1#top", page()),
        (4, "http://b.net/4", page("/go?u=https://x.com/de/a")),
        (5, "http://c.net/dir/sub/page", page("../up")),
        (6, "http://c.net/dir/up", page("http://x.com/de/bad")),
        (7, "http://d.net/list?page=1", page("?page=2")),
        (8, "http://d.net/list?page=2", page("http://x.com/de/bad")),
        (9, "http://d.net/list?page=3", page("#top")),
        (10, "http://e.net", page("x/./../y?a=1&amp;b=2")),
        (11, "http://e.net/y?a=1&b=2", page("http://x.com/fr/../de/")),
        (12, "http://f.net/12", page("mailto:a@b.c?u=http://x.com/de/a")),
    ]
    got = {r.page_id: r.verdict for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [i for i in sorted(got) if got[i] == "block"] == [1, 3, 5, 6, 7, 8, 10, 11]


def test_the_sql_of_addresses_agrees_where_pages_name_targets(spark):
    import random

    import duckdb

    from lakewarden.llm import queries

    draw = random.Random(3)
    hosts = ["a.net", "www.a.net", "B.net", "c.org", "x.com", "m.example.org"]
    tails = ["", "/", "/de/1", "/fr/2", "/es/", "/en/17", "/dir/sub/page", "/dir/./page", "/list?page=1", "/list?page=2#top", "/index.html", "/a/../de/b"]
    said = [*tails, "page", "../up", ".", "..", "/../x/..", "?page=2", "#top", "", "go?u=https://x.com/de/a&amp;b=1", "mailto:a@b.c", "//x.com/de/y", "/x/./../y"]
    url = lambda: f"http{draw.choice(['', 's'])}://{draw.choice(hosts)}{draw.choice(tails)}"
    target = lambda: url() if draw.random() < 0.5 else draw.choice(said)
    rows = [(i, url(), page(target() if i % 2 else "", target() if i % 3 == 0 else "")) for i in range(120)]
    rows += [(5, rows[5][1], rows[5][2]), (200, "no url", rows[1][2]), (201, None, None), (202, "http://q.net", "")]
    con = duckdb.connect()
    con.execute("create table pages(page_id bigint, url varchar, html varchar)")
    for some in (rows, rows[:7], [r for r in rows if r[0] % 4 == 1], []):
        con.execute("delete from pages")
        if some:
            con.executemany("insert into pages values (?, ?, ?)", some)
        got = urls.filter_urls(spark.createDataFrame(some, "page_id long, url string, html string"))
        cur = con.execute(queries.ORACLES["op9_url_filter"])
        assert [d[0] for d in cur.description] == got.columns
        assert sorted(map(repr, cur.fetchall())) == sorted(repr(tuple(r)) for r in got.collect())


def test_a_dense_label_does_not_grow(spark):
    rng = np.random.default_rng(9)
    center = rng.standard_normal(64)
    # Mean cosine 0.9: what a linked pair may lie apart along a direction is most of the whole spread.
    data = center + np.sqrt((1 / 0.9 - 1) * (center @ center) / 64) * rng.standard_normal((3000, 64))
    points = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(data)], "id long, root long, vector array<double>")
    leaves = neardup_vectors.forest(points, 0.93, trees=2, leaf=400)
    assert leaves.groupBy("id").count().agg(F.min("count"), F.max("count")).first() == (2, 2)
    assert leaves.select("leaf").distinct().count() == 2


def linked(rows, cosine=0.93):
    fine = [(i, np.array(v, float), x) for i, v, x in rows if x is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    links = []
    for a in range(len(fine)):
        for b in range(a):
            (i, v, x), (j, w, y) = fine[a], fine[b]
            if x == y and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= cosine:
                links.append((i, j))
    return links


def vectors_with_groups():
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(16).tolist(), i % 3) for i in range(600)]
    center = rng.standard_normal(16)
    rows += [(1000 + i, (center + 0.12 * rng.standard_normal(16)).tolist(), 1) for i in range(300)]
    rows += [(2000 + i, center.tolist(), 1) for i in range(40)]
    rows += [(3000, None, 1), (3001, [0.0] * 16, 1), (3002, [None, *center[1:].tolist()], 1), (3003, [float("nan"), *center[1:].tolist()], 1), (3004, center.tolist(), None), (3005, center[:8].tolist(), 1), (3006, [], 1), (3007, (3 * center).tolist(), 1)]
    return rows


@pytest.mark.parametrize("leaf", [64, 5000])
def test_linked_vectors_equal_brute_force(spark, leaf, monkeypatch):
    monkeypatch.setattr(neardup_vectors, "BLOCK", 100)
    from tests.llm.test_texts import components

    rows = vectors_with_groups()
    links = linked(rows)
    want, count = components(links, [r[0] for r in rows]), {r[0]: 0 for r in rows}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    frame = with_clashes(rows, "vec_id long, embedding array<double>, label int", spark)
    got = neardup_vectors.near_duplicates(frame, leaf=leaf).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {i: (count[i], want[i], want[i] == i) for i in want}
    assert neardup_vectors.near_duplicates(frame.limit(0)).count() == 0


def test_search_recall_and_order(spark):
    rows = duck_vectors()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = permutations.nearest(frame, F.col("vec_id") % 20 == 0, k=20, block=700, query_block=20).collect()
    ids, data = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    hits = total = 0
    for query in ids[ids % 20 == 0]:
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == query)
        score = data @ data[ids == query][0]
        assert [r[0] for r in mine] == list(range(1, 21))
        assert mine == [(k + 1, i, s) for k, (s, i) in enumerate(sorted(((s, i) for _, i, s in mine), key=lambda x: (-x[0], x[1])))]
        assert all(abs(s - score[ids == i][0]) < 1e-9 for _, i, s in mine)
        best = set(ids[ids != query][np.lexsort((ids[ids != query], -score[ids != query]))[:20]].tolist())
        hits, total = hits + len(best & {r[1] for r in mine}), total + 20
    assert hits / total >= 0.9


@pytest.mark.parametrize("huge", [1e8, float(np.finfo(np.float32).max)])
def test_search_recall_beside_a_huge_vector(spark, huge):
    rows = duck_vectors()
    rows.append((2001, (huge * np.array(rows[7][1])).tolist()))
    got = permutations.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=20).collect()
    ids, data = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    hits = total = 0
    for query in ids[ids % 20 == 0]:
        score = data @ data[ids == query][0]
        best = set(ids[ids != query][np.lexsort((ids[ids != query], -score[ids != query]))[:20]].tolist())
        hits, total = hits + len(best & {r.vec_id for r in got if r.query_id == query}), total + 20
    assert hits / total >= 0.9


def duck_vectors():
    import duckdb

    return duckdb.sql("select vec_id, embedding::double[] from '/root/testdata/sf0.1/embeddings.parquet' where vec_id < 2000 order by 1").fetchall()


def test_search_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (3, [1.0, 1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (4, None), (40, [0.0, 0.0]), (60, [float("nan"), 1.0]), (80, [None, 1.0]), (100, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    frame = with_clashes(rows, "vec_id long, embedding array<double>", spark)
    got = sorted(tuple(r) for r in permutations.nearest(frame, F.col("vec_id") % 20 == 0, k=20).collect())
    assert got == [(0, 1, 2, 1.0), (0, 2, 3, 1.0), (0, 3, 20, 0.0), (20, 1, 2, 2.0), (20, 2, 3, 2.0), (20, 3, 0, 0.0)]
    assert permutations.nearest(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline
    from lakewarden.llm import minhash, packing, pii, substring
    from lakewarden.session import cut

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumns({n: F.lit("x") for n in ("spans", "span_id", "kept", "id", "row")})
    docs = cut(docs, "test-documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        after = cut(stage(spark, docs, "/root/testdata/sf0.001"), f"test-{name}")
        before, rows = {r.doc_id: r for r in docs.collect()}, after.collect()
        if name != "sequences":
            assert after.columns == columns and after.schema == docs.schema
        if name == "language":
            assert {r.doc_id for r in rows} == {i for i, r in before.items() if any(c.isalpha() for c in r.text or "")}
        if name == "near_duplicates":
            assert {r.doc_id for r in rows} == {r.doc_id for r in minhash.near_duplicates(docs).collect() if r.kept}
        if name == "repeated_passages":
            removed = {r.doc_id: r for r in substring.remove_repeats(docs).collect()}
            assert {r.doc_id for r in rows} == {i for i, r in removed.items() if r.n_removed < r.n_words or not r.n_removed}
            assert all(len(r.text.split()) == removed[r.doc_id].n_words - removed[r.doc_id].n_removed for r in rows)
            assert all(r.text == before[r.doc_id].text for r in rows if not removed[r.doc_id].n_removed)
        if name == "privacy":
            assert all(r.text == pii.rewrite(before[r.doc_id].text, corpus_pipeline.PII_KEY)[0] and r.n_chars == len(r.text) for r in rows)
        if name == "sequences":
            want = sorted((r.doc_id, r.piece, r.ids_crc32) for r in packing.pack(docs).collect())
            assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in rows) == want
        docs = after


def test_pipeline_rows_that_share_an_id_or_have_none(spark, base_text):
    import corpus_pipeline

    said = base_text.split()
    near, other, third = " ".join([*said[:200], "changed", *said[201:]]), " ".join(f"o{i}" for i in range(90)), " ".join(f"t{i}" for i in range(90))
    rows = [(1, base_text), (1, base_text), (3, near), (3, other), (None, third), (None, third), (None, base_text), (9, third), (None, "lonely words")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = corpus_pipeline.near_duplicates(spark, frame, "").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, base_text), (3, other), (9, third), (None, "lonely words")], key=str)
    got = corpus_pipeline.repeated_passages(spark, frame, "").collect()
    kept = [r for r in got if r.text in (base_text, other, third, "lonely words")]
    assert sorted(map(tuple, kept), key=str) == sorted([(1, base_text), (3, other), (9, third), (None, "lonely words")], key=str)
    assert [tuple(r) for r in got if r not in kept] == [(3, "changed")]
    mixed = spark.createDataFrame([(5, other), (5, f"{other} {third}"), (5, third)], "doc_id long, text string").coalesce(1)
    got = corpus_pipeline.repeated_passages(spark, mixed, "").collect()
    assert sorted(w for r in got for w in r.text.split()) == sorted(f"{other} {third}".split())


def test_pipeline_without_rows(spark, tmp_path):
    import corpus_pipeline

    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
