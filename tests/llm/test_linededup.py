from collections import defaultdict

from tests.llm.data import edge_docs, empty_docs
from voxelyard.llm import linededup as d


def brute(rows, min_sites, min_words):
    sites, first = defaultdict(set), {}
    for doc_id, text, site in rows:
        for raw in (text or "").split("\n"):
            line = raw.strip(" \t\n\x0b\x0c\r")
            if line and len(line.split()) >= min_words:
                sites[line].add(site)
                if doc_id is not None:
                    first[line] = min(doc_id, first.get(line, doc_id))
    out = []
    for doc_id, text, _ in rows:
        if text is None:
            out.append((doc_id, None))
            continue
        seen, left = set(), []
        for raw in text.split("\n"):
            line = raw.strip(" \t\n\x0b\x0c\r")
            if len(sites[line] - {None}) >= min_sites:
                if first.get(line) != doc_id or line in seen:
                    continue
                seen.add(line)
            left.append(raw)
        out.append((doc_id, "\n".join(left)))
    return sorted(map(str, out))


def test_against_brute_force(spark):
    rows = []
    for i in range(200):
        lines = [f"own line number {i} here", " shared by very many sites " if i % 2 else "shared by very many sites"]
        lines += ["only three sites have this"] if i % 60 < 3 else []
        lines += ["exactly at the threshold line"] if i < 5 else []
        lines += ["one below the threshold line"] if i < 4 else []
        lines += ["ok then"] + (["shared by very many sites"] if i == 0 else [])
        rows.append((i, "\n".join(lines), f"s{i % 17}" if i % 11 else None, 1))
    rows += [(500, None, "s1", 1), (501, "", "s2", 1), (None, "shared by very many sites", "s3", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, pos int")
    for sent in (d.SENT_LINES, 0):  # both ways of cutting
        out = d.drop_boilerplate(frame, min_sites=5, sent_lines=sent)
        assert sorted(str((r.doc_id, r.text)) for r in out.collect()) == brute([r[:3] for r in rows], 5, d.MIN_WORDS)


def test_both_ways_agree(spark):
    lines = [f"{word} line with \u00e9 {'x' * k}" for k, word in enumerate(["first", "second", "third", "fourth\x0b"] * 10)]
    rows = [(i, "\r\n".join(lines[i % 7 :: i % 5 + 1]) + "\n", f"s{i}") for i in range(60)] * 2
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    ways = [d.drop_boilerplate(frame, sent_lines=n) for n in (d.SENT_LINES, 0)]
    first, second = (sorted(map(str, w.collect())) for w in ways)
    assert first == second and sum(r.removed_lines for r in ways[0].collect()) > 100


def test_edges(spark):
    docs = edge_docs(spark)
    out = d.drop_boilerplate(docs)
    assert out.columns == [*docs.columns, "removed_lines"]
    assert sorted(map(str, out.drop("removed_lines").collect())) == sorted(map(str, docs.collect()))
    assert d.drop_boilerplate(empty_docs(spark)).count() == 0


def test_repeated_ids_and_clashing_names_in_both_ways(spark):
    """Rows that share an id, or have none, lose their own lines alone; a column of the result's name gives way."""
    shared = [f"line number {k} on many sites" for k in range(3)]
    rows = [(i, "\n".join([*shared, f"own words of {i} here"]), f"s{i}", 7, "a", "b") for i in range(20)]
    rows += [(3, "own words of 3 here\n" + shared[1], "x", 7, "a", "b"), (None, shared[0] + "\nkept line of this one", "y", 7, "a", "b"), (None, "other\n\n" + shared[2], "y", 7, "a", "b")] * 2
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, removed_lines int, __cut string, `a.b` string")
    want = brute([r[:3] for r in rows], 5, d.MIN_WORDS)
    for sent in (d.SENT_LINES, 0):
        out = d.drop_boilerplate(frame, min_sites=5, sent_lines=sent)
        assert out.columns == ["doc_id", "text", "source", "__cut", "a.b", "removed_lines"]
        got = out.collect()
        assert sorted(str((r.doc_id, r.text)) for r in got) == want
        assert sum(r.removed_lines for r in got) == 57 + 2 + 4
