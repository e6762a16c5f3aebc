"""Passages that repeat inside lines, against every window compared."""

import random
import re

from heliograph.llm import passages, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string")


def invented(rng, n, wrap=0):
    words = [f"{rng.choice('abcdefgh')}{rng.randrange(3000)}" for _ in range(n)]
    return " ".join(words) if not wrap else "\n".join(" ".join(words[i : i + wrap]) for i in range(0, n, wrap))


def brute_words(docs, size):
    """Words left and ids of the first holders, by all windows in order of (doc_id, place)."""
    first, out = {}, {}
    for d, t in sorted(docs, key=lambda r: r[0]):
        words = WORD.findall(t or "")
        gone, holders = set(), set()
        for p in range(len(words) - size + 1):
            at = first.setdefault(tuple(w.lower() for w in words[p : p + size]), (d, p))
            if at[0] != d or p - at[1] >= size:
                gone |= set(range(p, p + size))
                holders.add(at[0])
        out[d] = ([w for i, w in enumerate(words) if i not in gone], len(gone), sorted(holders))
    return out


def check(spark, docs, size=50):
    got = {r["doc_id"]: r for r in substring_dedup.dedup_paragraphs(frame(spark, docs), span=size).collect()}
    want = brute_words(docs, size)
    assert {d: (WORD.findall(r["text"] or ""), r["n_span_words"], r["first_doc_ids"]) for d, r in got.items()} == want
    return got


def test_passages_inside_long_and_wrapped_lines(spark):
    rng = random.Random(12)
    planted = [invented(rng, n) for n in (50, 51, 60, 85, 148)]
    docs = []
    for d in range(40):
        own = [invented(rng, rng.randrange(100, 500)), invented(rng, rng.randrange(100, 500))]
        middle = rng.choice(planted).split(" ")
        if d % 4 == 1:  # wrapped at nine words, so that no line is long
            middle = " ".join(middle).upper().split(" ")
            own = ["\n".join([own[0], "x y"]), own[1]]
        sep = [" "] * len(middle) if d % 4 != 1 else ["\n" if i % 9 == 8 else "  " for i in range(len(middle))]
        docs.append((d, own[0] + " " + "".join(w + s for w, s in zip(middle, sep)) + own[1]))
    docs += [(50, invented(rng, 300, 9)), (51, None), (52, "")]
    docs.append((53, docs[-3][1].replace("\n", " ")))  # the same words in one line
    docs.append((54, planted[0].rsplit(" ", 1)[0]))  # 49 words: too few
    got = check(spark, docs)
    assert sum(r["n_spans"] for r in got.values()) >= 34
    assert got[51]["text"] is None and got[54]["text"] == docs[-1][1] and got[53]["text"] == ""
    assert all(r["n_removed"] == 0 for d, r in got.items())


def test_texts_that_repeat_themselves(spark):
    rng = random.Random(13)
    seven = " ".join(f"s{i % 7}" for i in range(20))
    docs = [
        (0, "\n".join(["a b c d e"] * 60)), (1, "\n".join(["a b c d e"] * 13)), (2, "\n".join([seven] * 1 + ["k l m n"] * 30)),
        (3, invented(rng, 60, 10)), (4, invented(rng, 70, 10)),
    ]
    docs.append((5, docs[3][1] + "\n" + docs[4][1] + "\n" + docs[3][1]))
    got = check(spark, docs)
    assert WORD.findall(got[0]["text"]) == list("abcde") * 10


def test_small_windows(spark):
    rng = random.Random(14)
    docs = [(d, "\n".join(" ".join(rng.choice("abcd") for _ in range(rng.randrange(1, 12))) for _ in range(rng.randrange(1, 9)))) for d in range(60)]
    check(spark, docs, 16)


def test_blanks_beside_a_cut():
    cut = passages.without
    assert cut("a b c d", [(1, 3)]) == "a d"
    assert cut("a b c\nd", [(1, 3)]) == "a\nd"
    assert cut("a\nb c\nd", [(1, 3)]) == "a\nd"
    assert cut("a\nb c d", [(1, 3)]) == "a\nd"
    assert cut("a b\nc d", [(0, 2)]) == "c d"
    assert cut("a b\nc d", [(2, 4)]) == "a b"
    assert cut("a b c d e", [(0, 1), (2, 3), (4, 5)]) == "b d"
    assert cut("a b", [(0, 2)]) == ""


def test_any_doc_id_and_any_number_of_lines(spark):
    rng = random.Random(15)
    line, run = invented(rng, 30), invented(rng, 60)
    last = invented(rng, 25)
    docs = [
        (2**62, line + "\n" + invented(rng, 30)), (-(2**62), invented(rng, 30) + "\n" + line), (7, "\n" * (1 << 22) + last), (8, last), (None, line),
        (None, "x " + run + " y"), (None, "z " + run), (None, None), (9, run.replace(" ", "\n") + "\n1"), (9, run.replace(" ", "\n") + "\n1"),
    ]
    rows = substring_dedup.dedup_paragraphs(frame(spark, docs)).collect()
    assert len(rows) == len(docs)
    got = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert got[-(2**62)]["n_removed"] == 0 and got[2**62]["text"] == docs[0][1].split("\n")[1] and got[2**62]["first_doc_ids"] == [-(2**62)]
    assert got[7]["text"] == docs[2][1] and got[8]["text"] == "" and got[8]["first_doc_ids"] == [7]
    assert [r["text"] for r in rows if r["doc_id"] == 9] == [docs[-1][1]] * 2
    unnamed = {("none" if r["text"] is None else r["text"], r["n_removed"], r["n_span_words"], tuple(r["first_doc_ids"])) for r in rows if r["doc_id"] is None}
    assert unnamed == {("", 1, 0, (-(2**62),)), ("none", 0, 0, ()), ("x y", 0, 60, (9,)), ("", 1, 0, ())}  # "z" goes as a line like "x y"


def test_clashing_names(spark):
    run, line = " ".join(f"r{i}" for i in range(60)), " ".join(f"l{i}" for i in range(25))
    names = ["_row", "told", "gone", "starts", "line", "key"]
    rows = [(1, "a " + run + " b\n" + line, *range(6)), (2, "c " + run + "\n" + line, *range(6)), (3, None, *range(6)), (4, "clean text", *range(6))]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    got = substring_dedup.dedup_paragraphs(df)
    assert got.columns == ["doc_id", "text", *names, *substring_dedup.ADDED]
    found = {r["doc_id"]: r for r in got.collect()}
    # Both holders are told by n_repeat_words; only the later one loses anything, and clean texts have none.
    assert [(found[d]["text"], found[d]["n_removed"] > 0, found[d]["n_repeat_words"] >= 85) for d in (1, 2, 3, 4)] == [(rows[0][1], False, True), ("", True, True), (None, False, False), ("clean text", False, False)]
    assert all(list(r[2:8]) == list(range(6)) for r in found.values())
