"""Line deduplication against every pair of lines compared."""

import random

from heliograph.llm import line_dedup


def brute(docs, similarity=0.8):
    lines = [((d, i), line, frozenset(w for w in line.lower().split(" ") if w)) for d, t in docs if t is not None for i, line in enumerate(t.split("\n"))]
    lines.sort(key=lambda x: x[0])
    gone, seen = set(), []
    for place, _, words in lines:
        if not words:
            continue
        if any(len(words & o) >= similarity * len(words | o) for o in seen):
            gone.add(place)
        seen.append(words)
    out = []
    for d, t in docs:
        if t is None:
            out.append((d, None, 0, 0))
            continue
        parts = t.split("\n")
        kept = [x for i, x in enumerate(parts) if (d, i) not in gone]
        out.append((d, "\n".join(kept), len(parts), len(parts) - len(kept)))
    return sorted(out, key=lambda r: r[0])


def run(spark, docs):
    df = spark.createDataFrame([(d, t, "x", 5) for d, t in docs], "doc_id long, text string, words string, n_lines int")
    got = line_dedup.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "words", "n_lines", "n_removed"]
    return sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in got.collect()), key=lambda r: r[0])


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "\n\n"), (4, "a"), (5, "A"), (6, "a  a"), (7, "a b c d e\nx"), (8, "a b c d\ny"), (9, "b a d c\n\nx"), (10, "same\nsame\nother words here")]
    assert run(spark, docs) == brute(docs)
    assert run(spark, []) == []


def test_random_lines(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    for n in (4, 9, 25):
        base = [[rng.choice(vocabulary) for _ in range(rng.randrange(1, n))] for _ in range(60)]
        docs = []
        for d in range(40):
            lines = []
            for _ in range(rng.randrange(1, 6)):
                line = list(rng.choice(base))
                if rng.random() < 0.6:
                    line[rng.randrange(len(line))] = rng.choice(vocabulary)
                lines.append(" ".join(line))
            docs.append((d, "\n".join(lines)))
        assert run(spark, docs) == brute(docs)


def test_generated_documents(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").filter("doc_id < 120").collect()]
    assert run(spark, docs) == brute(docs)


def test_emptied_rows_go(spark):
    df = spark.createDataFrame([(1, "one line"), (2, "one line"), (3, "one line\nand more"), (4, None), (5, "")], "doc_id long, text string")
    got = line_dedup.dedup_lines(df, drop_emptied=True).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == [(1, "one line"), (3, "and more"), (4, None), (5, "")]


def test_clashing_names_and_ids(spark):
    columns = ["doc_id", "text", "_id", "_gone", "_text", "tag", "left", "id", "k0"]
    rows = [(1, "same words here\nalone one", *range(7)), (1, "other text\nsame words here", *range(7)), (None, "same words here", *range(7)), (3, None, *range(7)), (3, "same words here", *range(7)), (3, "same words here", *range(7))]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id int, _gone int, _text int, tag int, left int, id int, k0 int")
    got = line_dedup.dedup_lines(df)
    assert got.columns == [*columns, "n_lines", "n_removed"]
    # Rows without a doc_id come first; rows of one doc_id lose only lines of their own; repeated rows share a fate.
    assert sorted((str(r["doc_id"]), str(r["text"]), r["n_removed"]) for r in got.collect()) == [
        ("1", "alone one", 1), ("1", "other text", 1), ("3", "", 1), ("3", "", 1), ("3", "None", 0), ("None", "same words here", 0),
    ]


def test_long_lines_and_large_groups(spark):
    rng = random.Random(3)
    base = [f"word{i}" for i in range(150)]
    near = []
    for d in range(60):
        line = list(base)
        for _ in range(rng.randrange(0, 12)):
            line[rng.randrange(len(line))] = f"odd{rng.randrange(40)}"
        near.append((d, " ".join(line) + "\n" + " ".join(f"w{rng.randrange(10**6)}" for _ in range(3000))))
    assert run(spark, near) == brute(near)


def test_few_rarity_buckets(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "RARITY_BUCKETS", 4096)
    monkeypatch.setattr(line_dedup, "MARK_WORDS", 4096)
    rng = random.Random(9)
    docs = [(d, "\n".join(" ".join(f"v{int(rng.paretovariate(0.4)) % 20000}" for _ in range(9)) for _ in range(20))) for d in range(60)]
    docs += [(100 + d, t.replace("v1 ", "zz ")) for d, t in docs[:30]]
    assert run(spark, docs) == brute(docs)


def met_pairs(spark, docs, settled):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    classes = line_dedup.line_classes(df, line_dedup.rarity_levels(df), 0.8)
    gone = classes.filter(settled).select("id")
    return [r for part in range(line_dedup.PARTS) for r in line_dedup.prefix_pairs(classes, gone, 0.8, part).collect()]


def test_long_unlike_lines_do_not_meet(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(600)]
    docs = [(d, " ".join(rng.sample(vocabulary, rng.randrange(130, 170)))) for d in range(80)]
    assert len(met_pairs(spark, docs, "false")) < 80  # of 3,160 pairs, most of which 64 bits can't tell apart


def test_settled_later_lines_do_not_meet(spark):
    base = [f"w{i}" for i in range(30)]
    docs = [(d, " ".join([*base, f"x{d % 6}", f"y{d}"])) for d in range(12)]
    assert met_pairs(spark, docs, "false")
    assert met_pairs(spark, docs, "first.doc_id > 0") == []


def test_sets_around_the_width_of_parities(spark):
    rng = random.Random(12)
    base = [f"word{i}" for i in range(line_dedup.NARROW + 8)]
    docs = []
    for d in range(60):
        line = base[: rng.randrange(line_dedup.NARROW - 8, line_dedup.NARROW + 8)]
        for _ in range(rng.randrange(0, 9)):
            line[rng.randrange(len(line))] = f"odd{rng.randrange(30)}"
        docs.append((d, " ".join(line)))
    assert run(spark, docs) == brute(docs)
