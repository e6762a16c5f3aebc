"""Operators 1, 2, 3, 5, 6, 8 and 10 against plain Python, on odd small tables and on sf0.001."""

import random

import brute
import duckdb
import public_tokenizers
import pytest
import xxhash
import zstandard
from brute import base_licenses, decontaminate, edited, pieces
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from heliograph.llm import decontamination, fingerprints, language_id, licenses, packing, token_counts, url_filter
from heliograph.llm.oracles import op3_sql

DOCS = "doc_id long, text string, lang string, source string, rank long, hash string, words string"
LONG = "The quick brown fox jumps over the lazy dog again and again. " * 900
ODD = [
    (0, None), (1, ""), (2, "..."), (3, "one"), (4, "Licensed under CC BY-NC 4.0. All rights reserved. cc by"), (5, LONG), (6, LONG), (6, LONG),
    (7, "GNU General Public\nLicense  general public license"), (8, "naïve Straße \u212a İ 日本語 e\u0301 <|endoftext|> x"), (9, "a b c d e f g h i j k l m"),
    (10, "x a b c d e f g h i j y a b c d e f g h i j"), (11, "tab\tand  blanks   here \n\n z "), (None, "no id here at all"), (12, "short ITEM words"),
]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", 1, "h", "w") for d, t in rows], DOCS)


def small(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def key(row):
    return tuple((x is None, x) if not isinstance(x, bool) else x for x in row)


def rows(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=key)


ITEMS = [(1, "A b c d e f g h i j K"), (2, "short item"), (3, ""), (4, None), (5, "b c d e f g h i j k l m"), (2, "one"), (10, "a b c d e f g h i j"), (None, "lazy dog again")]


def test_decontamination(spark, sf_dir):
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, row long")
    assert rows(decontamination.decontaminate(frame(spark, ODD), items), *names) == sorted(decontaminate(ODD, ITEMS), key=key)
    assert rows(decontamination.decontaminate(frame(spark, []), items), *names) == []
    none = rows(decontamination.decontaminate(frame(spark, ODD), items.limit(0)), *names)
    assert none == sorted(decontaminate(ODD, []), key=key)
    docs, own = small(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = rows(decontamination.decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), own), *names)
    assert got == sorted(decontaminate(docs, [tuple(r) for r in own.select("item_id", "text").collect()]), key=key)
    assert any(r[5] for r in got)


def test_licenses(spark, sf_dir):
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    for docs in (ODD, [], small(spark, sf_dir)):
        got = licenses.scan_licenses(frame(spark, docs))
        assert rows(got, *names) == sorted(base_licenses(docs), key=key)
    found = {r["doc_id"]: r for r in licenses.scan_licenses(frame(spark, ODD)).collect()}
    assert found[4]["labels"] == "cc-by,cc-by-nc-4.0,reserved" and found[4]["score"] == 1.0 and found[1]["score"] == 0.0


def test_license_with_an_inserted_word(spark):
    docs = [(1, "x licensed under the very apache license version 2 0 y"), (2, "licensed under the sun")]
    got = {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(frame(spark, docs)).collect()}
    assert got == {1: "apache-2.0", 2: ""}


def test_license_templates_of_one_word_are_refused(spark):
    with pytest.raises(ValueError, match="unlicense"):
        licenses.scan_licenses(frame(spark, ODD), [licenses.Template(0, "u", ("unlicense",), True)])


def test_decontamination_by_shuffle(spark, monkeypatch):
    """The join of many shingles, and rows that come in another order whenever they are read."""
    from heliograph.llm import words

    monkeypatch.setattr(words, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    items = spark.createDataFrame([(i, t) for i, t in ITEMS], "item_id long, text string")
    docs = frame(spark, ODD).repartition(5).orderBy("rank").withColumn("noise", F.rand())
    assert rows(decontamination.decontaminate(docs, items), *names) == sorted(decontaminate(ODD, ITEMS), key=key)


def chain_set(text, size=2):
    """Hashed chains in plain Python."""
    blank = {ord(c): " " for c in "\n\t\r\f\v\x01\x02"}
    text = (text or "").translate({ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}).translate(blank)
    words = [w for w in "".join(c for c in text if not (33 <= ord(c) < 127 and not c.isalnum())).split(" ") if w]
    content = [w for w in words if w not in fingerprints.ANCHORS]
    hashed = lambda a, follow: xxhash.xxh64(follow.encode(), seed=xxhash.xxh64(a.encode(), seed=42).intdigest()).intdigest()
    found, k = set(), 0
    for w in words:
        if w not in fingerprints.ANCHORS:
            k += 1
        elif k + size <= len(content):
            found.add(hashed(w, " ".join(content[k : k + size])))
    if content:
        found.add(hashed("", " ".join(content[:size])))
    elif words:
        found.add(hashed("", "\x01".join(words) + "\x01\x02"))
    return found


def written(chains):
    """A fingerprint's text: chains as signed 64-bit numbers in order."""
    return "".join(f"{h:016X}" for h in sorted(chains, key=lambda h: h - (h >> 63 << 64)))


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_chains_and_likeness(spark, sf_dir):
    odd = ["the of in red car blue boat", "the", "the of", "red", "the red", "THE of red, car.", "a\x01b the\x02c d", "red the car of in boat the end"]
    for docs in ([(d, t) for d, t in ODD if d is not None and d != 6], list(enumerate(odd)), small(spark, sf_dir)):
        ordered = sorted(docs, key=lambda r: r[0])
        got = {r["doc_id"]: r for r in fingerprints.fingerprint_documents(frame(spark, docs)).collect()}
        for i, (d, text) in enumerate(ordered):
            text, after = text or "", ordered[(i + 1) % len(ordered)][1] or ""
            quarter = len(text) // 4
            own, follows, other = chain_set(text), chain_set(after), chain_set(text[: len(text) - quarter] + after[:quarter])
            assert got[d]["fingerprint"] == written(own), text[:99]
            assert got[d]["edited_fingerprint"] == written(other)
            assert abs(got[d]["near_edited"] - jaccard(own, other)) < 1e-9 and abs(got[d]["near_next"] - jaccard(own, follows)) < 1e-9


def diagonal_votes(text, templates):
    """(labels, score) by plain loops over every place of every template."""
    w, labels, score = brute.words(text), set(), 0.0
    for t in templates:
        places = {}
        for at in range(len(w) - 1):
            for p in range(len(t.words) - 1):
                if (w[at], w[at + 1]) == t.words[p : p + 2]:
                    places.setdefault(at - p, set()).add(p)
        if t.base:
            if any(len(held) == len(t.words) - 1 for held in places.values()):
                labels.add(t.label)
                score = 1.0
            continue
        spans, before = [], None
        for diagonal in sorted(places):
            if before is None or diagonal - before > licenses.NEIGHBOURS:
                spans.append(set())
            spans[-1] |= places[diagonal]
            before = diagonal
        for span in spans:
            cover = len({q for p in span for q in (p, p + 1)}) / len(t.words)
            if cover >= licenses.COVER:
                labels.add(t.label)
                score = max(score, cover)
    return ",".join(sorted(labels)), score


@pytest.mark.parametrize("rows_at_once", [200_000, 0])
def test_license_votes(spark, sf_dir, monkeypatch, rows_at_once):
    from heliograph.llm import words

    monkeypatch.setattr(words, "BROADCAST_ROWS", rows_at_once)
    monkeypatch.setattr(licenses, "BROADCAST_ROWS", rows_at_once)
    rng, templates = random.Random(4), licenses.default_templates()
    docs = []
    for d in range(120):
        own = []
        for _ in range(rng.randrange(1, 4)):
            part = list(rng.choice(templates).words)
            for _ in range(rng.randrange(0, 3)):
                at = rng.randrange(len(part))
                part[at : at + rng.randrange(0, 2)] = rng.choice([[], ["odd"], ["two", "odd"]])
            own += ["and"] * rng.randrange(0, 3) + part
        docs.append((d, " ".join(own)))
    docs += [(1000 + d, t) for d, t in small(spark, sf_dir)] + [(9000, None), (9001, ""), (9002, LONG)]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(frame(spark, docs)).collect()}
    for d, t in docs:
        labels, score = diagonal_votes(t, templates)
        assert (got[d]["labels"], round(got[d]["score"], 9)) == (labels, round(score, 9)), t
    assert len({got[d]["labels"] for d in range(120)}) > 10


def test_fingerprints(spark, sf_dir):
    for docs in (ODD, [], [(5, "only one of the rows")], small(spark, sf_dir)):
        got = fingerprints.fingerprint_documents(frame(spark, docs)).collect()
        ordered = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
        want = edited(ordered)
        assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=key) == sorted(want, key=key)
        by_text = {}
        texts = {d: t or "" for d, t in docs}
        for r in got:
            assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
            assert by_text.setdefault(texts[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]


def test_fingerprint_pairs(spark):
    rng = random.Random(3)
    texts = [" ".join(f"the {rng.choice('abcdefgh')}{rng.randrange(9)} {rng.randrange(99)}" for _ in range(rng.choice([3, 20, 40]))) for _ in range(25)]
    texts += [t.rsplit(" the ", 1)[0] for t in texts[:15]] + texts[:3] + ["", None]
    docs = frame(spark, list(enumerate(texts)))
    sets = {r["doc_id"]: set(r["s"]) for r in docs.select("doc_id", fingerprints.chains(fingerprints.F.coalesce("text", fingerprints.F.lit(""))).alias("s")).collect()}
    first = {}
    for i, s in sets.items():
        first.setdefault(frozenset(s), i)
    ids = sorted(i for s, i in first.items() if s)
    want = {(a, b) for a in ids for b in ids if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    got = {(r["a"], r["b"]) for r in fingerprints.near_pairs(docs).collect()}
    assert got == want and want


def test_fingerprint_links(spark, sf_dir):
    """Classes and link counts of the query against all pairs of documents."""
    rng = random.Random(4)
    texts = [" ".join(f"the w{rng.randrange(60)} x{rng.randrange(60)}" for _ in range(rng.choice([4, 12, 30]))) for _ in range(20)]
    variants = [f"{t} of v{k} u{k}" for t in texts[:5] for k in range(12)]
    many = texts + texts[:6] + variants + ["", None, "the", "Only Two"]
    for docs in (list(enumerate(many)), [*ODD], small(spark, sf_dir), []):
        got = fingerprints.fingerprint_documents(frame(spark, docs)).collect()
        assert len(got) == len(docs)
        sets = [(d, frozenset(chain_set(t))) for d, t in docs]
        smallest = {}
        for d, s in sets:
            smallest.setdefault(s, set()).add(d)
        want = []
        for d, s in sets:
            ids = [i for i in smallest[s] if i is not None]
            links = sum(s != o and len(s & o) >= 0.8 * len(s | o) for o in smallest if o and s)
            want.append((d, (min(ids) if ids else None) if s else d, links))
        assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in got), key=key) == sorted(want, key=key)
    assert any(w[2] > 2 for w in want) or not want


def test_packing(spark, sf_dir):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for docs in (ODD, [], small(spark, sf_dir)):
        got = packing.pack(frame(spark, docs)).collect()
        want = pieces(docs, lambda t: library.encode(t, add_special_tokens=False).ids)
        assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
        bins = {}
        for r in got:
            bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for held in bins.values():
            at = 0
            for offset, length in sorted(held):
                assert offset == at
                at += length
            assert at <= 4096
        total = sum(r["length"] for r in got)
        assert len(bins) <= -(-total // 4096) * 1.05 + 2


@pytest.mark.parametrize("seed", range(5))
def test_plan_fills_every_slot_once(seed):
    rng = random.Random(seed)
    counts = {n: rng.randrange(1, 40) for n in rng.sample(range(1, 101), 30)}
    taken = {}
    plan = packing.best_fit_plan(counts, 100)
    for length, n in counts.items():
        runs = sorted(r for r in plan if r[0] == length)
        for rank in range(n):
            _, first, per, lo, offset = max(r for r in runs if r[1] <= rank)
            step = rank - first
            taken.setdefault(lo + step // per, []).append((offset + step % per * length, length))
    for held in taken.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 100


def test_token_counts(spark, sf_dir, tmp_path):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for docs in (ODD, [], small(spark, sf_dir)):
        want = sorted(((d, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for d, t in docs), key=key)
        cache = str(tmp_path / f"cache{len(docs)}")
        names = ["doc_id", "n_bytes", "n_tokens", "over_limit"]
        assert rows(token_counts.count_tokens(frame(spark, docs), cache), *names) == want
        before = spark.read.parquet(cache).count()
        assert rows(token_counts.count_tokens(frame(spark, docs), cache), *names) == want
        assert spark.read.parquet(cache).count() == before == len({t or "" for _, t in docs})


def test_urls(spark):
    urls = [
        None, "", "no scheme.com/", "http://A.COM/x", "http://com/", "http://com", "http://www.example.com/en/1?q", "http://example.com/en/", "http://x.example.com/en/",
        "http://x.www.example.com/en/", "http://example.com/EN/", "http://example.net/es/", "http://net/fr/#a", "http://example.net/de/", "http://notcom/", "http://acom/",
        "http://spam-farm.example.org/", "http://www.cheap-pills.org/x", "http://a.com#x", "https://u@b.com:80/", "x://y://z/", "http://exämple.com/é",
    ]
    pages = spark.createDataFrame([(i, u, "h", "x") for i, u in enumerate(urls)], "page_id long, url string, rule string, host string")
    got = url_filter.filter_urls(pages)
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", list(enumerate(urls)))
    names = ["page_id", "host", "path", "rule", "verdict", "pattern"]
    assert rows(got, *names) == sorted(con.sql(f"select {', '.join(names)} from ({op3_sql()})").fetchall(), key=key)
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def test_rarest_token_is_the_index_entry():
    rule = url_filter.Rule("block", "r", "cheap-pills", ("cheap", "pills"), 0)
    assert list(url_filter.RuleIndex([rule], {"cheap": 9, "pills": 2}).by_token) == ["pills"]


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs.filter(~language_id.held_out()))
    found = language_id.identify(docs.filter(language_id.held_out()), model)
    got = found.select("lang", "lang_pred", "rejected").collect()
    right = sum(r["lang"] == r["lang_pred"] for r in got) / len(got)
    assert right >= 0.95, right
    assert sum(r["rejected"] for r in got) <= 0.02 * len(got)


def plain_language(text, dictionaries, level, block):
    """(language, score, margin) by a plain loop over zstandard."""
    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0, 0.0
    raw = text.lower().encode("utf-8", "surrogatepass")
    ends = list(range(block, len(raw), block)) + [len(raw)]
    if len(ends) > 1 and ends[-1] - ends[-2] < block // 2:
        del ends[-2]
    sizes = []
    for lang, held in dictionaries.items():
        total, at = 0, 0
        for end in ends:
            d = zstandard.ZstdCompressionDict(held, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            total += len(zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress(raw[at:end]))
            at = end
        sizes.append((total, lang))
    (least, lang), (second, _) = sorted(sizes)[:2]
    margin = (second - least) / second
    return lang, min(1.0, 0.5 + 2 * margin), margin


def test_language_by_a_plain_loop(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.fit(docs.filter(~language_id.held_out()))
    long = [(900, "Das ist ein langer Satz und noch einer. " * 400), (901, "zz"), (902, "the same 12")]
    texts = {r["doc_id"]: r["text"] for r in docs.filter("doc_id < 60").collect()} | dict(long) | {903: None, 904: "", 905: "12 .."}
    found = language_id.identify(frame(spark, list(texts.items())).select("doc_id", "text"), model).collect()
    assert len(found) == len(texts)
    for r in found:
        lang, score, margin = plain_language(r["text"], model.dictionaries, model.level, model.block)
        assert (r["lang_pred"], r["rejected"]) == (lang, lang == "und" or margin < language_id.MARGIN) and abs(r["score"] - score) < 1e-9
    assert model.dictionaries == language_id.fit(docs.filter(~language_id.held_out()).repartition(7)).dictionaries


def test_language_ties(spark):
    model = language_id.Model({"fr": b"equal text " * 50, "en": b"equal text " * 50})
    r = language_id.identify(frame(spark, [(1, "equal text here")]), model).first()
    assert (r["lang_pred"], r["score"], r["rejected"]) == ("en", 0.5, True)


def test_language_odd_rows(spark):
    model = language_id.Model({"en": b"the of and to a in is " * 50, "fr": b"le la les de des et en " * 50})
    got = {r["doc_id"]: r for r in language_id.identify(frame(spark, ODD), model).collect()}
    assert got[0]["lang_pred"] == got[1]["lang_pred"] == got[2]["lang_pred"] == "und" and got[2]["score"] == 0
    assert got[5]["lang_pred"] == "en" and got[5]["hash"] == "h"
    assert language_id.identify(frame(spark, []), model).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(frame(spark, ODD), language_id.Model({})).collect()} == {"und"}
    assert language_id.fit(frame(spark, [])).dictionaries == {}
