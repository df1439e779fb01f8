"""Every query of the registry against its SQL; the others against what can be said of them."""

import pytest
from compare import rows_of, rows_of_sql
from conftest import SF

from quarrymill.operators import chunking
from quarrymill.plans import documents, registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_its_sql(spark, name):
    got = registry.QUERIES[name](spark, SF)
    columns, want = rows_of_sql(registry.ORACLES[name], SF)
    assert sorted(got.columns) == columns
    assert rows_of(got, columns) == want


def test_html_pages_render(spark):
    rows = registry.QUERIES["html_to_markdown"](spark, SF).collect()
    assert len(rows) == 50 and not any("<p>" in r.markdown or "track(" in r.markdown for r in rows)
    # A page whose article is under the least size is rendered from its body, so it begins with whatever its body begins with.
    short = {r.page_id for r in rows if not r.markdown.startswith("# ")}
    assert short == {2, 11, 35, 45}
    titles = {r.page_id: r.title for r in registry.QUERIES["html_title"](spark, SF).collect()}
    assert not any(titles[r.page_id] and r.markdown.startswith(titles[r.page_id]) for r in rows)


def test_least_size_of_a_main_part():
    from quarrymill.sources.html_markdown import to_markdown

    page = "<html><head><title>T</title></head><body><p>menu</p><article>{}</article></body></html>"
    assert to_markdown(page.format("x" * 81)) == "x" * 81 + "\n"
    assert to_markdown(page.format("x" * 80)) == "menu\n\n" + "x" * 80 + "\n"


def test_chunks_tile_their_parents(spark):
    rows = registry.QUERIES["chunk_markdown"](spark, SF).collect()
    top = {(r.doc_id, r.seq): r for r in rows if r.is_parent}
    for r in rows:
        if not r.is_parent:
            p = top[r.doc_id, r.parent_seq]
            assert p.char_start <= r.char_start < r.char_end <= p.char_end and r.parent_id == p.chunk_id
    assert len({r.chunk_id for r in rows}) == len(rows)
    # Only a piece of one sentence over the size may have more tokens: it is cut by its mean characters per token.
    whole = chunking.chunk_markdown(documents._docs_md(spark, SF), chunking.Config(size=128, overlap=16, parent_size=512)).where("not is_parent").collect()
    assert len(whole) == len(rows) - len(top) and all(r.token_count <= 128 or len(chunking.sentences(r.text)) == 1 for r in whole)


def test_hard_cut_goes_by_mean_characters():
    text = "a " * 100 + "longwordlongword " * 20  # 120 tokens in 540 characters
    cut = chunking.hard_cut(chunking._part("text", 0, text), 16, 0)
    assert [p.end - p.start for p in cut] == [72] * 7 + [36] and cut[0].tokens == 36


def test_chunk_pages_follow_offsets(spark):
    rows = [r for r in registry.QUERIES["chunk_pages"](spark, SF).collect() if r.page_from is not None]
    assert rows and all(r.page_from <= r.page_to for r in rows)


def test_titles_with_all_references_equal_their_sql(spark, tmp_path):
    """Without a semicolon, by number, of no name, beside tags, and with what cleaning drops."""
    parts = ["and&amp", "&am", "&amp;&amp", "&ampamp;", "&notit;", "&copyx", "&hellip;", "&#65", "&#x41;", "&#X4g", "&#0;", "&#128;", "&#xD800;", "&#99999999999;", "&#;", "&", "& ", "&amp<i>;</i>", "&quot", '<b class="a>b">x</b>', "<!-- c -->", "​", "﻿", "　", "é", "'"]
    rows = [(n, f"<html><head><title>{a} {b}</title></head><body><h1 id='q'>{b}{a}</h1></body></html>") for n, (a, b) in enumerate((a, b) for a in parts for b in parts)]
    rows += [(len(rows) + n, x) for n, x in enumerate([None, "", "<p>x", "<!-- <title>no</title> --><title>yes</title>", "<script>'<title>no</title>'</script><TITLE >yes</TITLE >"])]
    spark.createDataFrame(rows, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/made")
    next(tmp_path.glob("made/part-*.parquet")).rename(tmp_path / "pages.parquet")
    got = registry.QUERIES["html_title"](spark, str(tmp_path))
    columns, want = rows_of_sql(registry.ORACLES["html_title"], str(tmp_path))
    assert rows_of(got, columns) == want and len(want) == len(rows)
    assert {r.title for r in got.collect()} >= {"and& &am", "&& &"}


def test_throttled_steps_equal_their_sql_at_the_edges(spark, tmp_path):
    """Events within a millisecond, and within microseconds, of a step's edge, on both sides of 1970."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    at = [k * 100_000_000 + d for k in (-3, 0, 1, 17_061_961) for d in (-100_000_000, -501, -500, -400, -1, 0, 1, 499_999)]
    rows = [(n, t, n % 3, "purchase", 20.0 * (n % 2), "{}") for n, t in enumerate(at)]
    columns = {"event_id": pa.int64(), "ts": pa.timestamp("us"), "user_id": pa.int64(), "event_type": pa.string(), "value": pa.float64(), "props": pa.string()}
    pq.write_table(pa.table([pa.array(x, k) for x, k in zip(zip(*rows), columns.values())], list(columns)), tmp_path / "events.parquet")
    got = registry.QUERIES["progress_throttle"](spark, str(tmp_path))
    columns, want = rows_of_sql(registry.ORACLES["progress_throttle"], str(tmp_path))
    assert rows_of(got, columns) == want and want
