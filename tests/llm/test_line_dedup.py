"""Cleaned texts against the SQL check and a plain version."""

from collections import defaultdict

import duckdb
import pytest

from caseweave.llm.line_dedup import SQL, remove_boilerplate


def plain(rows, min_sites, min_words):
    sites, keeper = defaultdict(set), {}
    for doc, text, site in rows:
        for line in (text or "").split("\n"):
            t = line.strip(" \t\x0b\x0c\r")
            if len(t.split()) >= min_words:
                sites[t].add(site or "")
                if doc is not None:
                    keeper[t] = min(doc, keeper.get(t, doc))
    out = []
    for doc, text, _ in rows:
        seen, left, lines = set(), [], (text or "").split("\n")
        for line in lines:
            t = line.strip(" \t\x0b\x0c\r")
            bad = len(sites.get(t, ())) >= min_sites
            if not bad or (keeper.get(t) == doc and doc is not None and t not in seen):
                left.append(line)
            seen.add(t)
        out.append((doc, 0, 0, None) if text is None else (doc, len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out, key=repr)


def got(df):
    assert df.columns == ["doc_id", "n_lines", "n_removed", "text"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("min_sites, min_words", [(10, 4), (3, 2), (2, 1)])
def test_documents(documents, min_sites, min_words):
    rows = [(r.doc_id, r.text, r.source) for r in documents.collect()]
    want = plain(rows, min_sites, min_words)
    assert got(remove_boilerplate(documents, min_sites, min_words)) == want


def test_sql(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    want = sorted(con.execute(SQL).fetchall(), key=repr)
    assert got(remove_boilerplate(spark.read.parquet(path))) == want and any(r[2] for r in want)


def test_near_the_threshold(spark):
    """Sites by the hundred, where a sketch alone would be wrong now and then."""
    rows = [
        (1000 * n + s, f"line number {n}\nown words of {n} {s}", f"site{s}") for n in range(90, 112) for s in range(n)
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert got(remove_boilerplate(docs, 100, 3)) == plain(rows, 100, 3)


def test_odd_rows(odd, none):
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    assert got(remove_boilerplate(odd, 2, 2)) == plain(rows, 2, 2)
    assert remove_boilerplate(none).count() == 0


def test_hot_and_rare_sites_and_rows_without_an_id(spark):
    """A third of all rows on one site; lines on two, three and four sites; many rows have no id."""
    rows = [(None if i % 4 == 0 else i, f"own {i} of {i} here\nshared by some of {i % 7} of them", "hot" if i % 3 == 0 else f"s{i % 5 % (1 + i % 7)}") for i in range(300)]
    rows += [(None, "shared by some of 6 of them\nx", "hot")] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = plain(rows, 3, 4)
    assert got(remove_boilerplate(docs)) == want and 0 < sum(r[2] for r in want) < 320
