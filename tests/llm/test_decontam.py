import pickle
import re

import pytest

from quillframe.llm import decontam as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


ITEMS = [(1, "One two, three four five six seven eight nine ten eleven twelve"), (2, "kurz émile"), (3, None), (4, "..."), (2, "kurz émile"), (None, "x y z"), (10, "b " * 12)]
DOCS = [(1, "zero one TWO three four-five six seven eight nine ten; eleven end"), (2, "x kurz, Émile"), (3, "x kurz. émile émile"), (4, None), (5, ""), (6, "b " * 30), (7, "nothing at all " * 4000 + "kurz émile"), (8, "one two three four five six seven eight nine"), (8, "x y z")]


def brute(docs, items, n=10):
    windows = {}
    for i, t in items:
        w = fold(t)
        size = min(n, len(w))
        if size:
            for k in range(len(w) - size + 1):
                windows.setdefault(tuple(w[k : k + size]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, ids = fold(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                found = windows.get(tuple(w[k : k + size]))
                if found:
                    hit.update(range(k, k + size))
                    ids |= found - {'None'}
        out.append((d, len(w), len(hit), sorted(ids)))
    return sorted(out)


def frames(spark, docs=DOCS, items=ITEMS):
    return spark.createDataFrame([(i, t, "h") for i, t in docs], "doc_id long, text string, _hits string"), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block_words", [200_000, 5])
def test_hits(spark, block_words):
    docs, items = frames(spark)
    got = dc.find_benchmark_hits(docs.select("doc_id", "text").repartition(2), items, block_words=block_words).collect()
    mine = sorted((r["doc_id"], r["_n_words"], sum(b - a for a, b in zip(r["_hits"][::2], r["_hits"][1::2], strict=True)), sorted(r["_items"])) for r in got)
    assert mine == brute(DOCS, ITEMS)


def test_removal(spark):
    docs, items = frames(spark)
    clean = dc.decontaminate(docs, items)
    assert clean.columns == docs.columns and sorted(r["doc_id"] for r in clean.collect()) == [2, 4, 5, 8]  # É is no lower-case é
    assert clean.filter("_hits <> 'h'").isEmpty()
    spans = {r["doc_id"]: r["text"] for r in dc.decontaminate(docs, items, mode="span").collect()}
    assert spans[1] == "zero   end" and spans[3] == "x   émile" and spans[4] is None
    assert dc.find_benchmark_hits(dc.decontaminate(docs, items, mode="span"), items).filter("size(_hits) > 0").isEmpty()


def test_empty_sides(spark):
    docs, items = frames(spark)
    assert dc.decontaminate(docs, items.limit(0)).count() == len(DOCS)
    assert dc.decontaminate(docs.limit(0), items).count() == 0


def test_broadcast_tables_are_plain_values():
    """Executors may not have this package: a broadcast is pickled by reference to it otherwise."""
    tables = dc.scan_tables([(str(i), [b"w%d" % k for k in range(i, i + 12)]) for i in range(50)], 10)
    assert b"quillframe" not in pickle.dumps(tables)
    assert dc.find_windows(tables, [b"w%d" % k for k in range(3, 15)])[1] >= {"3"}
