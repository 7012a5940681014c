"""Text operators against plain versions of their definitions, awkward rows included."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from geoloom.llm import byte_bpe, jaccard, langid, line_dedup, marks, packing, pii, subword, token_orc

RANKS, BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "word_bpe_49k.json"))


# ---- 1, personal data ----

def plain_base(text):
    """The base patterns as they are stated, by Python's own search."""
    luhn = lambda d: sum((int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10))) for i, c in enumerate(d[::-1])) % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = [(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
             (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in s.split("."))),
             (r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))),
             (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15)]
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(rules) for m in re.finditer(p, text) if ok(m[0]))


@given(st.text(alphabet="a1.@+- ()4-%z\n", max_size=60))
@settings(max_examples=500, deadline=None)
def test_base_patterns(text):
    assert pii.base_spans(text) == plain_base(text)


def test_pii_keeps_base_and_adds_spans(spark, docs, texts):
    model = pii.train(docs)
    rows = pii.digest(pii.find(docs, model)).collect()
    assert len(rows) == len(texts)
    want = Counter()
    for d, t, *_ in texts:
        base = plain_base(t or "")
        n = Counter(k for _, k, _ in base)
        written = ",".join(f"{pii.KINDS[k]}:{a}:{e}" for a, k, e in base)
        want[(d, *(n[k] for k in range(4)), hashlib.sha256(written.encode()).hexdigest())] += 1
        for r in rows:
            if r["doc_id"] == d and d is not None:
                assert set(filter(None, written.split(","))) <= set(r["spans"].split(","))
    assert Counter(tuple(r[:6]) for r in rows) == want


def test_pii_trees_find_disguises():
    """Trained on many plain matches, the trees accept other formats and refuse look-alikes."""
    rng, examples = np.random.default_rng(0), []
    def card():
        d = "4" + "".join(map(str, rng.integers(0, 10, 14)))
        return next(d + str(c) for c in range(10) if pii.luhn(d + str(c)))
    made = [f"word from {card()} and mail to u{i}.{i}@mail{i % 9}.example.com or +1 ({rng.integers(200, 999)}) 555-{rng.integers(1000, 9999)} there {card()[:-2]}" for i in range(300)]
    x = [(i % 5 == 0, k, g, f) for i, t in enumerate(made) for g, k, f in pii._examples(t)]
    learn, aside = [e for e in x if not e[0]], [e for e in x if e[0]]
    trees = pii.BoostedTrees().fit(np.array([e[3] for e in learn]), np.array([float(e[2]) for e in learn]))
    p = trees.probability(np.array([e[3] for e in aside]))
    good = np.array([e[2] for e in aside])
    assert ((p > 0.5) == good).mean() > 0.95


NEIGHBOURS = [("415-555-2671 415-555-2672", 3, ["415-555-2671", "415-555-2672"]), ("(415) 555-2671 (415) 555-2672", 3, ["(415) 555-2671", "(415) 555-2672"]),
              ("4111.1111.1111.1111 5500.0000.0000.0004", 2, ["4111.1111.1111.1111", "5500.0000.0000.0004"]),
              ("4111/1111/1111/1111 2024", 2, ["4111/1111/1111/1111"])]


@pytest.mark.parametrize("text,kind,parts", NEIGHBOURS)
def test_pii_neighbouring_numbers(text, kind, parts):
    """Every number of a run is proposed, at either end of it and in a run of any length."""
    for t in (text, f"a {text} b", " ".join([text] * 500)):
        assert set(parts) <= {t[a:e] for a, k, e in pii.candidates(t) if k == kind}
    found = pii.candidates(" ".join([text] * 500))
    assert len(found) <= 500 * len(pii.candidates(" ".join([text] * 3)))


def test_pii_neighbours_are_redacted():
    """Trained on plain matches, the trees pick the numbers out of lists of them and not their parts."""
    rng = np.random.default_rng(1)
    def card():
        d = "4" + "".join(map(str, rng.integers(0, 10, 14)))
        return next(d + str(c) for c in range(10) if pii.luhn(d + str(c)))
    def phone():
        return f"{rng.integers(200, 999)}-{rng.integers(200, 999)}-{rng.integers(1000, 9999)}"
    made = [f"word from {card()} or +1 ({rng.integers(200, 999)}) 555-{rng.integers(1000, 9999)} there {card()[:-2]}" for _ in range(300)]
    x = [(g, f) for t in made for g, _, f in pii._examples(t)]
    model = pii.PiiModel(pii.BoostedTrees().fit(np.array([f for _, f in x]), np.array([float(g) for g, _ in x])), (2.0, 2.0, 0.5, 0.5))
    hit = total = 0
    for _ in range(100):
        cards = [".".join(c[i:i + 4] for i in range(0, 16, 4)) for c in (card(), card())]
        for numbers, kind in ((cards, 2), ([phone(), phone()], 3)):
            t = "see " + " ".join(numbers) + " there"
            want = {(t.index(n), kind, t.index(n) + len(n)) for n in numbers}
            hit += len(want & set(model.spans(t)[1]))
            total += len(want)
    assert hit > 0.9 * total


def test_redaction(spark, docs, texts):
    got = {r["doc_id"]: r["text"] for r in pii.redact(docs, pii.train(docs)).collect()}
    assert "a.b@c.de" not in got[1_014] and "<email>" in got[1_014] and "<card>" in got[1_014]
    assert got[1_001] is None and got[1_002] == "" and got[1_006] == "one"


def _draws(spark, texts):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    return df, dict(df.select("text", F.xxhash64("text")).collect())


def test_pii_copies_do_not_fill_the_sample(spark):
    """2,000 copies of a text, or a text with 1,000 matches, in front of all others by hash: the model stays as without them."""
    rng = np.random.default_rng(2)
    made = [f"w{i} +1 ({rng.integers(200, 999)}) 555-{rng.integers(1000, 9999)} there, u{i}@mail{i % 9}.example.com" for i in range(120)]
    df, draws = _draws(spark, made)
    first = min(draws, key=draws.get)
    plain = pii.train(df, sample_spans=2_000)
    assert plain.thresholds[3] <= 1
    copied = pii.train(spark.createDataFrame([(t,) for t in made + [first] * 2_000], "text string").repartition(4), sample_spans=2_000)
    assert copied.thresholds == plain.thresholds
    many = " ".join(f"u{j}@mail{j}.example.com" for j in range(1_000))
    _, at = _draws(spark, [f"x{i} {many}" for i in range(600)])
    long = min(at, key=at.get)
    assert at[long] < draws[first]
    assert pii.train(spark.createDataFrame([(t,) for t in [*made, long]], "text string"), sample_spans=2_000).thresholds[3] <= 1


def test_pii_learns_from_all_texts(spark):
    """Cards stand only in texts that come last by hash, behind more examples than any sample held."""
    rng = np.random.default_rng(3)
    phones = [f"w{i} +1 ({rng.integers(200, 999)}) 555-{rng.integers(1000, 9999)} there" for i in range(1_200)]
    def card():
        d = "4" + "".join(map(str, rng.integers(0, 10, 14)))
        return next(d + str(c) for c in range(10) if pii.luhn(d + str(c)))
    _, of = _draws(spark, phones)
    late = sorted(of.values())[1_000]
    _, at = _draws(spark, [f"paid with {card()} on day {i}" for i in range(1_500)])
    cards = [t for t, draw in at.items() if draw > late]
    assert len(cards) > 100
    model = pii.train(spark.createDataFrame([(t,) for t in phones + cards], "text string").repartition(3))
    assert model.thresholds[2] <= 1 and model.thresholds[3] <= 1


def test_pii_examples_of_one_text_share_its_weight():
    many = " ".join(f"u{j}@mail{j}.example.com" for j in range(200))
    got = [e for e in pii._share(many, 16, False) if e[:2] == (True, 0)]
    assert len(got) > 16 and abs(sum(e[3] for e in got) - 16 * pii.UNIT) <= len(got)
    assert len([e for e in pii._share(many, 16, True) if e[:2] == (True, 0)]) == 16


def test_pii_empty(no_docs):
    model = pii.train(no_docs)
    assert model.trees is None and pii.digest(pii.find(no_docs, model)).count() == 0


# ---- 2, similarity join ----

def plain_components(rows, words, percent):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return frozenset(tuple(w[i:i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])
    sets = [(d, shingles(t)) for d, t, *_ in rows]
    parent = {d: d for d, _ in sets if d is not None}
    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                a_, b_ = find(a), find(b)
                parent[max(a_, b_)] = min(a_, b_)
    return Counter((d, len(s), find(d) if d is not None else None) for d, s in sets)


@pytest.mark.parametrize("words,percent", [(3, 90), (5, 80)])
def test_jaccard(spark, docs, texts, words, percent):
    got = jaccard.jaccard_components(docs, words=words, percent=percent)
    assert Counter(map(tuple, got.collect())) == plain_components(texts, words, percent)


def family(seed, size, length, edits):
    """Variants of one text, each with a few words changed; many pairs lie on either side of the threshold."""
    rng = np.random.default_rng(seed)
    base = [f"w{rng.integers(0, 400)}" for _ in range(length)]
    out = []
    for _ in range(size):
        t = list(base)
        for _ in range(rng.integers(0, edits + 1)):
            t[rng.integers(0, length)] = f"v{rng.integers(0, 40)}"
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("words,percent,block", [(3, 90, 256), (3, 90, 4), (5, 80, 8)])
def test_jaccard_families(spark, words, percent, block):
    """Large groups of near copies: links between members that only their differences to a pivot decide."""
    rows = [(i, t) for i, t in enumerate(t for s, (n, m, e) in enumerate([(60, 90, 4), (40, 150, 8), (30, 25, 2), (30, 12, 1), (25, 60, 6)]) for t in family(s, n, m, e))]
    rows = [(int(d), t) for d, (_, t) in zip(np.random.default_rng(5).permutation(len(rows)), rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = jaccard.jaccard_components(df, words=words, percent=percent, block=block)
    want = plain_components(rows, words, percent)
    assert len({c for _, _, c in want}) not in (1, len(rows))
    assert Counter(map(tuple, got.collect())) == want


@given(st.integers(1, 300), st.integers(0, 40), st.integers(0, 40), st.sampled_from([80, 90]), st.integers(0, 10 ** 6))
@settings(max_examples=300, deadline=None)
def test_linked_sets_share_a_list(n, lacks, extra, percent, seed):
    rng = np.random.default_rng(seed)
    words = np.unique(rng.integers(0, 2 ** 64, n + extra, dtype=np.uint64))
    a, b = words[:n], np.sort(np.concatenate([words[min(lacks, n - 1):n], words[n:]]))
    a = np.sort(a)
    common = len(np.intersect1d(a, b))
    if 100 * common >= percent * (len(a) + len(b) - common) and len(a) + len(b) > 2 * common:
        (x, p), (y, q) = jaccard.list_keys(a, percent), jaccard.list_keys(b, percent)
        assert len(np.intersect1d(x, y)) >= max(p, q) >= 1


@pytest.fixture
def tables(monkeypatch):
    """What an operator writes in between, as DataFrames."""
    out, cut = [], jaccard.Workspace.cut
    monkeypatch.setattr(jaccard.Workspace, "drop", lambda *_: None)
    monkeypatch.setattr(jaccard.Workspace, "_remove", lambda *_: None)
    monkeypatch.setattr(jaccard.Workspace, "cut", lambda self, df: out.append(cut(self, df)) or out[-1])
    return out


@pytest.mark.parametrize("block,large", [(256, False), (8, True)])
def test_jaccard_writes_differences_of_large_pivots_only(spark, tables, block, large):
    rows = list(enumerate(t for s in range(12) for t in family(s, 14, 90, 8)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter(map(tuple, jaccard.jaccard_components(df, block=block).collect()))
    want = plain_components(rows, 5, 80)
    assert got == want and len({c for _, _, c in want}) > 24         # several groups around most pivots
    assert any(t.where("size(lacks) + size(extra) > 0").count() for t in tables if "lacks" in t.columns) == large


def test_jaccard_leaves_out_pivots_shared_by_few_lists(spark, tables):
    """Texts of a few families with passages of other families: their lists meet many pivots, nearly all for nothing."""
    rng = np.random.default_rng(3)
    bases = [[f"b{b}w{i}" for i in range(200)] for b in range(20)]
    rows = []
    for d in range(160):
        t = list(bases[d % 20])
        for _ in range(4):
            o, at, n = rng.integers(0, 20), rng.integers(0, 170), rng.integers(8, 22)
            t[at:at + n] = bases[o][at:at + n]
        rows.append((d, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter(map(tuple, jaccard.jaccard_components(df).collect()))
    assert got == plain_components(rows, 5, 80)
    pairs = next(t for t in tables if t.columns == ["node", "pivot"])
    assert pairs.count() <= 400                                      # 622 if every list counts


def test_jaccard_shuffles_sets_once_and_only_marked_texts(spark, docs):
    ids = docs.where("doc_id % 7 = 3").select("doc_id").distinct()
    got = Counter(r[0] for r in marks.with_mark(docs, ids, "_mark").where("_mark").select("doc_id").collect())
    assert got == Counter(r[0] for r in docs.where("doc_id % 7 = 3").select("doc_id").collect())
    space = jaccard.Workspace(spark, "test")
    sets = space.cut(spark.range(40).select(F.col("id").alias("node"), F.array(F.col("id"), F.col("id") + 1).alias("s")))
    pairs = space.cut(spark.range(1, 40).select(F.col("id").alias("node"), F.lit(0).cast("long").alias("pivot")))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stars = jaccard._stars(pairs, sets, 80, 256)
        stars.collect()
        assert re.search(r"ReusedExchange \[node#\d+L, s#\d+\]", stars._jdf.queryExecution().executedPlan().toString())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_near_copies_shuffles_texts_of_copies_only(spark, monkeypatch):
    """Large tables: no side is small enough to be broadcast by itself."""
    rows = [(None, "a b c", "en"), (None, "a b c", "en"), *((d, f"x{d % 60} y z", "en") for d in range(100))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    groups = spark.range(100).select(F.col("id").alias("doc_id"), (F.col("id") % 60).alias("component_id"))
    monkeypatch.setattr(corpus_pipeline.jaccard, "jaccard_components", lambda *_a, **_k: groups)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = corpus_pipeline.near_copies(spark, df, "")
        assert Counter(map(tuple, out.collect())) == Counter(r for r in rows if r[0] is None or r[0] < 60)
        assert "Union" in (plan := out._jdf.queryExecution().optimizedPlan().toString()) and "LeftAnti" in plan
        kept = plan[plan.index("Union"):plan.index("LeftAnti")]                # what no copy is goes past the anti join
        assert "Join LeftOuter" in kept and "strategy=broadcast" in kept
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_jaccard_empty(no_docs):
    assert jaccard.jaccard_components(no_docs).count() == 0


# ---- 4, 7, 9, token ids ----

def test_packing(docs, texts):
    t = Tokenizer.from_file(WORDS)
    t.encode_special_tokens = True
    ids = [(d, [*t.encode(x or "", add_special_tokens=False).ids, 2]) for d, x, *_ in texts]
    rows = packing.pack(docs, WORDS, pieces_per_shard=50).collect()
    want = Counter()
    for d, own in ids:
        for s in range(0, len(own), 4096):
            want[(d, s, len(own[s:s + 4096]), zlib.crc32(np.array(own[s:s + 4096], "<u4")), len(own))] += 1
    assert Counter(tuple(r[:5]) for r in rows) == want
    lie = defaultdict(list)
    for r in rows:
        lie[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in lie.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= 4096


@given(st.lists(st.integers(1, 64), max_size=200))
@settings(max_examples=100, deadline=None)
def test_best_fit_decreasing(lengths):
    """The segment tree gives what a search over all open windows gives."""
    lengths = sorted(lengths, reverse=True)
    number, offset = packing.best_fit_decreasing(np.array(lengths, np.int64), 64)
    room = []
    for n, w, o in zip(lengths, number, offset):
        fits = [r for r in room if r >= n]
        if fits:
            assert 64 - o == min(fits) == room[w]
        else:
            assert w == len(room) and o == 0
            room.append(64)
        room[w] -= n


def test_byte_round_trip(docs, texts):
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=subword.read_ranks(RANKS), special_tokens={})
    want = Counter()
    for d, x, *_ in texts:
        ids = e.encode_ordinary(x or "")
        want[(d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest())] += 1
    got = byte_bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN)
    assert Counter(map(tuple, got.collect())) == want


def test_ids_offsets_and_text(spark, texts):
    df = spark.createDataFrame([(x,) for _, x, *_ in texts if not x or len(x) < 9_000], "text string")
    rows = byte_bpe.decode_ids(byte_bpe.encode_texts(df, RANKS, public_tokenizers.PATTERN, offsets=True), RANKS).collect()
    table = {v: k for k, v in subword.read_ranks(RANKS).items()}
    for r in rows:
        text = r["text"] or ""
        assert r["decoded_text"] == text and bytes(r["decoded"]) == text.encode()
        at, starts = 0, []
        for i in r["ids"]:                                     # a token starts in the character that its first byte belongs to
            starts.append(len(text.encode()[:at + 1].decode("utf-8", "ignore")) - (len(text.encode()[:at + 1].decode("utf-8", "ignore")) > len(text.encode()[:at].decode("utf-8", "ignore"))))
            at += len(table[i])
        assert list(r["char_starts"]) == starts
    half = spark.createDataFrame([(byte_bpe.encode_texts(df.limit(0), RANKS, public_tokenizers.PATTERN).count(), [subword.read_ranks(RANKS)[b"\xe6"]])], "n long, ids array<int>")
    assert byte_bpe.decode_ids(half, RANKS).first()["decoded_text"] == "�"


@pytest.mark.parametrize("kind,path", [("byte_json", BYTES), ("word_json", WORDS), ("ranks", RANKS)])
@given(parts=st.lists(st.sampled_from([" ", "  ", "\n", "\t", "a", "the", "The", "'s", "É", "ß", "́", " ", " ", "\x85", "\x1c", ".", ",", "...", "12", "½", "日本", "<|endoftext|>", "👍", "×", "÷", "İ"]), max_size=14))
@settings(max_examples=300, deadline=None)
def test_units_change_nothing(kind, path, parts):
    text = "".join(parts)
    if kind == "ranks":
        want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=subword.read_ranks(path), special_tokens={}).encode_ordinary(text) if not hasattr(test_units_change_nothing, "e") else test_units_change_nothing.e.encode_ordinary(text)
        if not hasattr(test_units_change_nothing, "e"):
            test_units_change_nothing.e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=subword.read_ranks(path), special_tokens={})
    else:
        want = subword.encoder(kind, path).tokenizer.encode(text, add_special_tokens=False).ids
    e = subword.encoder(kind, path, public_tokenizers.PATTERN if kind == "ranks" else None)
    ids, rows = e.encode(pa.array(["x", text, None, text]))
    assert ids[rows[1]:rows[2]].tolist() == want == ids[rows[3]:rows[4]].tolist()


def test_token_orc(spark, docs, texts, folder):
    path = folder + "/ids"
    token_orc.write_token_orc(docs, path, BYTES, rows_per_file=7)
    t = Tokenizer.from_file(BYTES)
    t.encode_special_tokens = True
    own = {(d, x): [*t.encode(x or "", add_special_tokens=False).ids, 2] for d, x, *_ in texts}
    want, at = [], 0
    for d, x, *_ in sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = own[(d, x)]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4"))))
        at += len(ids)
    assert sorted(map(tuple, token_orc.token_index(spark, path).collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1])) == want
    found = token_orc.read_token_orc(spark, path).where("doc_id = 1009").collect()
    assert len(found) == 1 and list(found[0]["ids"]) == own[(1_009, next(x for d, x, *_ in texts if d == 1_009))]


def test_token_operators_on_nothing(spark, no_docs, folder):
    assert packing.pack(no_docs, WORDS).count() == 0
    assert byte_bpe.round_trip(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0
    token_orc.write_token_orc(no_docs, folder + "/none", BYTES)
    assert token_orc.token_index(spark, folder + "/none").count() == 0


# ---- 5, lines ----

def test_line_dedup(spark):
    rows = [(i, f"menu  \nbody {i}\n\n{'rare' if i < 3 else 'x'}\nmenu", "a") for i in range(20)]
    rows += [(100 + i, "menu\nother", "b") for i in range(4)] + [(200, None, "a"), (201, "", "a"), (202, "menu", None), (203, "menu", "a"), (203, "menu", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    names = ["_salt", "_marks", "_host", "_of", "_stay", "page", "host", "marks", "row", "stay", "n", "__text"]
    for name in [*names, "n_lines"]:
        df = df.withColumn(name, df.doc_id)
    out = line_dedup.drop_site_lines(df)
    assert out.columns == [c for c in df.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
    assert out.where(" or ".join(f"`{c}` is distinct from doc_id" for c in names)).isEmpty()
    got = {(r["doc_id"], r["source"]): (r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.drop_site_lines(df).collect()}
    assert got[(0, "a")] == ("body 0\n\nrare", 5, 2)          # three pages are too few for 'rare'
    assert got[(9, "a")] == ("body 9\n", 5, 3)
    assert got[(100, "b")] == ("menu\nother", 2, 0)           # the same line on another site
    assert got[(200, "a")] == (None, None, 0) and got[(201, "a")] == ("", 1, 0)
    assert got[(202, None)] == ("menu", 1, 0) and got[(203, "a")] == ("", 1, 1)
    assert line_dedup.drop_site_lines(df.where("false")).count() == 0
    assert line_dedup.drop_site_lines(df).count() == len(rows)


def test_lines_on_a_few_percent_of_a_large_site(spark):
    rows = [(i, f"body {i}\n" + ("share this\n" if i % 25 == 0 else "") + ("see also\n" if i % 60 == 0 else ""), "big") for i in range(3_000)]
    rows += [(5_000 + i, "a page\nwith many copies", "big") for i in range(500)] + [(9_000, "w" * 500_000 + "\nshare this", "big")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_site_lines(df).collect()}
    # on one page in 25 a line is the site's own, on one in 60 it isn't; copies of one page are one page
    assert got == {i: t.replace("share this\n", "").replace("\nshare this", "") for i, t, _ in rows}


def test_redact_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "mail a.b@c.de", "x", "y"), (2, None, "x", "y"), (3, "", "x", "y")], "doc_id long, text string, __text string, text_ string")
    out = pii.redact(df, pii.train(df))
    assert out.columns == df.columns
    assert [tuple(r) for r in out.orderBy("doc_id").collect()] == [(1, "mail <email>", "x", "y"), (2, None, "x", "y"), (3, "", "x", "y")]


def test_worded_addresses_of_any_length():
    for local in ("me", "l" * 80):
        for labels in (1, 2, 6, 12):
            address = f"{local} at " + " dot ".join(["host"] * labels + ["org"])
            assert (6, 0, 6 + len(address)) in pii.candidates(f"write {address}, please")


# ---- 10, language ----

def test_language_accuracy(spark, sf):
    from pyspark.sql import functions as F
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = langid.held_out(F.col("doc_id"))
    model = langid.train(docs.where(~held))
    rows = langid.identify(docs.where(held), model).select("lang", "lang_pred", "score").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert (model.weights == 0).mean() > 0.5                  # the penalty keeps the weights sparse


def test_language_odd_rows(docs, texts, no_docs):
    model = langid.train(docs)
    rows = langid.identify(docs, model).select("doc_id", "text", "lang_pred", "score").collect()
    assert len(rows) == len(texts)
    for r in rows:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1
    nothing = langid.train(no_docs)
    assert nothing.languages == [] and {r["lang_pred"] for r in langid.identify(docs, nothing).collect()} == {"und"}
    assert langid.identify(no_docs, model).count() == 0
