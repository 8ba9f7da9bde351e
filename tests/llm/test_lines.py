import hashlib

from fleetpulse.llm import lines, queries

LONG = "A line that many documents Share"


def plain(rows):
    """Brute force: (doc_id, n_lines, n_dropped, sha256) of every row."""
    strip = " \t\n\x0b\x0c\r"
    key = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(strip))
    held = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            held.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        all_lines = (t or "").split("\n")
        kept = []
        for line in all_lines:
            k = key(line)
            ids = held[k]
            last = max(ids, key=lambda x: (x is not None, x or 0))
            if not (len(k) >= 20 and len(ids) >= 3 and i != last):
                kept.append(line)
        out.append((i, len(all_lines), len(all_lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


ROWS = [
    (1, f"{LONG}\nfirst own\n\t{LONG.upper()}  \r\n"),
    (2, f"x\n{LONG}\x0b\ny\n\n{LONG}"),
    (7, f"{LONG}\n{LONG}"),
    (9, f"end {LONG}"),
    (10, None),
    (11, ""),
    (12, "\n\n"),
    (13, "twenty code points ée\nnineteen code point"),
    (14, "twenty code points ée\nnineteen code point"),
    (15, "twenty code points Ée\nnineteen code point"),
    (16, "twenty code points ée\nnineteen code point"),
    (None, f"{LONG}\nz"),
    (7, f"{LONG}\nanother text of the id"),
    (2, f"x\n{LONG}\x0b\ny\n\n{LONG}"),
    (5, "\n".join([LONG] * 3000 + ["tail"] * 3000)),
]


def test_query_against_brute_force(spark, tmp_path, documents):
    documents(ROWS).withColumnRenamed("n_chars", "pos").withColumnRenamed("lang", "h1").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op9_line_dedup(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect()), key=repr) == plain(ROWS)


def test_texts_and_columns(spark, documents):
    df = documents([(1, f"{LONG}\na\n\nb"), (2, LONG), (3, LONG)])
    kept = {r.doc_id: r.text for r in lines.drop_lines(df).collect()}
    assert kept == {1: "a\n\nb", 2: "", 3: LONG}
    assert lines.drop_lines(df).columns == [*df.columns, "_n_lines", "_n_dropped"]


def test_empty_table(spark, documents):
    assert lines.drop_lines(documents([])).collect() == []
