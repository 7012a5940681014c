"""Manifest, conversation repair and chat formatting against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from geoloom.llm import chat, manifest, repair

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def H(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


# --- manifest ---

def plain_leaf(r) -> str:
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))


def plain_tree(nodes: list[str]):
    paths, owners = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, above = [], []
        for a in range(0, len(nodes), 8):
            run = nodes[a:a + 8]
            for p in range(len(run)):
                for o in owners[a + p]:
                    paths[o].append(("".join(run[:p]), "".join(run[p + 1:])))
            up.append(H("".join(run)))
            above.append(sum(owners[a:a + 8], []))
        nodes, owners = up, above
    return nodes[0], paths


def plain_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    made = []
    for g in sorted(groups, key=lambda g: (g is not None, (g or "").encode())):
        own = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        made.append((own, *plain_tree([plain_leaf(r) for r in own])))
    root, above = plain_tree([sub for _, sub, _ in made])
    out = []
    for (own, sub, paths), up in zip(made, above):
        for r, p in zip(own, paths):
            shown = r
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                shown = (*r[:4], r[4].translate({ord(c): c.lower() for c in UPPER}))
            h = plain_leaf(shown)
            for b, a in p + up:
                h = H(b + h + a)
            out.append((r[0], plain_leaf(r), sub, root, H("".join(b + a for b, a in p + up)), h, h == root))
    return out


def made_rows(seed: int, n: int, langs, span: int, repeats: bool = False):
    rnd = random.Random(seed)
    ids = sorted({rnd.randrange(-span, span) for _ in range(n)})
    rows = [(i, rnd.choice(["s", "t", None, ""]), rnd.choice(langs), rnd.choice([None, 5, 17]), rnd.choice([None, "", "Abc", "abc", "ÄBc x" * 3, "w" * 200_000]))
            for i in ids]
    if repeats:
        rows += [rows[0]] * 30 + [(rows[1][0], "z", rows[1][2], k, "q") for k in range(20)]
        rows += [(None, "s", "en", k, "T") for k in range(9)] + [(None, "s", "en", 1, "T")] * 4
    return rows


@pytest.mark.parametrize("rows", [made_rows(1, 1, ["en"], 10), made_rows(2, 9, ["en", None], 10 ** 6), made_rows(3, 3_000, ["en"] * 8 + ["de", None, "", "é"], 3_000, True),
                                  made_rows(4, 200, ["en", None], 2 ** 63 - 1, True), made_rows(5, 700, [f"l{i}" for i in range(650)], 10 ** 6)],
                         ids=["one", "few", "repeated", "sparse", "groups"])
def test_manifest_equals_plain_trees(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    for clash in ("g", "node", "digest", "row", "_c", "_bit", "rank", "total", "path"):
        df = df.withColumn(clash, F.lit("clash"))
    shown = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.translate("text", UPPER, UPPER.lower())).otherwise(F.col("text"))
    key = lambda r: tuple(map(str, r))
    got = sorted((tuple(r) for r in manifest.manifest(df, shown={"text": shown}).collect()), key=key)
    assert got == sorted(plain_manifest(rows), key=key)


def test_manifest_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    assert manifest.manifest(none).count() == 0


# --- conversation repair ---

def plain_damage(rows):
    out = defaultdict(list)
    space = lambda v: " " if v is None else str(v)
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{space(c)}:{space(t)}".encode()) % 20
        role, text = space(role), space(text)
        out[c]
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out[c] += [(t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain_repair(rows):
    """Forward over all prefixes, least (cost, audit) for each last initial written."""
    allowed = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    out = []
    for c, own in plain_damage(rows).items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        turns = [r[0] for r in own if r[0] is not None]
        seen, faults = set(), []
        for _, role, text in own:
            end = text.rstrip(" \t\n\x0b\f\r")
            faults.append("b" if not end else "d" if (role, text) in seen else "t" if end[-1] not in ".!?" else "k")
            seen.add((role, text))

        def put(best, q, new):
            if q is not None and (q not in best or new[:2] < best[q][:2]):
                best[q] = new

        def inserted(best):
            for _ in range(4):
                for q, (cost, audit, said) in list(best.items()):
                    for role in ("user", "assistant"):
                        put(best, allowed.get((q, role[0])), (cost + 5, audit + "I", [*said, role + ":"]))
            return best
        best = inserted({"": (0, "", [])})
        for (_, role, text), f in zip(own, faults):
            new: dict = {}
            for q, (cost, audit, said) in best.items():
                put(new, q, (cost + 2, audit + "D", said))
                if f not in "bd":
                    more = 5 if f == "t" else 0
                    put(new, allowed.get((q, role[:1])), (cost + more, audit + "K", [*said, f"{role}:{text}"]))
                    for r in ("user", "assistant"):
                        put(new, allowed.get((q, r[0])), (cost + 1 + more, audit + "R", [*said, f"{r}:{text}"]))
            best = inserted(new)
        cost, audit, said = min(best[q] for q in ("", "a") if q in best)
        initials = [r[1][:1] for r in own]
        out.append((c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"),
                    sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, H("\n".join(said))))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.fixture(scope="module")
def talks():
    """Every fault and role in conversations of one to 300 rows, null ids and turns; no two rows tie on turn and role."""
    rnd = random.Random(3)
    rows = {}
    for c in [*range(150), None]:
        for t in range(rnd.choice([1, 2, 3, 5, 8, 40])):
            turn = t if rnd.random() > .05 else None
            role = rnd.choice(["user", "assistant", "system", "user", "assistant", "tool", None, ""])
            rows.setdefault((c, turn, role), rnd.choice(["A b.", "c", "d!", "", None, "Why? \n", "e f", f"x{rnd.random()}.", f"y{rnd.random()}."]))
    rows |= {(c, t, ("user", "assistant")[t % 2]): f"Hi {c} {t}." for c in range(300, 310) for t in range(30)}
    rows |= {(400, t, "system"): f"Hi {t}" for t in range(300)} | {(401, t, "user"): " " for t in range(300)}
    return [(c, t, role, text) for (c, t, role), text in rows.items()]


@pytest.mark.parametrize("bits", [2, 5, repair.CHUNK_BITS])
def test_repair_equals_plain_search(spark, talks, bits):
    df = spark.createDataFrame(talks, "conv_id long, turn long, role string, text string").repartition(7)
    for clash in ("h1", "pos", "cells", "at", "kind", "first", "audit", "blank", "row"):
        df = df.withColumn(clash, F.lit("clash"))
    got = [tuple(r) for r in repair.repair(repair.damage(df), df, bits).orderBy("conv_id").collect()]
    assert got == plain_repair(talks)


def test_repair_of_repeated_rows_and_nothing(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes.")]
    got = repair.repair(spark.createDataFrame(rows, schema), spark.createDataFrame([(1,), (1,), (2,)], "conv_id long")).orderBy("conv_id").collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, 1, 0, 1, 2, "KDK", H("user:Hi.\nassistant:Yes.")), (2, 0, 0, 0, 0, 0, 0, "", H(""))]
    none = spark.createDataFrame([], schema)
    assert repair.repair(repair.damage(none), none).count() == 0


def test_fix_up_stops_where_vectors_differ_by_a_constant():
    rnd = random.Random(5)
    for _ in range(300):
        cells = "".join(rnd.choice(repair.CELLS) for _ in range(rnd.randrange(1, 60)))
        right = repair.speculate("".join(rnd.choice(repair.CELLS) for _ in range(9)))[0][:4]
        assert repair.fix_up(cells, *repair.speculate(cells), tuple(right)) == repair.speculate(cells, tuple(right))


# --- chat formatting ---

RECORDS = [
    (1, '{"messages":[{"role":"user","content":"hi","x":1},{"role":"assistant","content":null}],"id":5}', "messages", [("user", "hi"), ("assistant", "")]),
    (2, '{"prompt":"p","response":"r","zz":{"messages":[1]}}', "prompt_response", [("user", "p"), ("assistant", "r")]),
    (3, '{"instruction":"i","input":null,"output":"o"}', "instruction", [("user", "i"), ("assistant", "o")]),
    (4, '{"output":"o","instruction":"i","system":"s","input":"n"}', "instruction", [("system", "s"), ("user", "i\n\nn"), ("assistant", "o")]),
    (5, '{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}', "conversations", [("user", "a"), ("assistant", "b")]),
    (6, "nope", None, None), (7, None, None, None), (8, '{"q":1}', None, None), (9, '{"messages":[]}', None, None), (None, "[1]", None, None),
    (10, '{"prompt":"p","completion":"c <s> [\\\\INST]"}', "prompt_completion", [("user", "p"), ("assistant", "c <s> [\\INST]")]),
    (11, '{"question":"q","answer":"a","context":"c"}', "question_answer", [("user", "c\n\nq"), ("assistant", "a")])]


def test_json_records_of_every_layout(spark):
    df = spark.createDataFrame([r[:2] for r in RECORDS], "conv_id long, record string").withColumn("turns", F.lit("clash")).withColumn("mark", F.lit("clash"))
    got = {r["conv_id"]: (r["layout"], r["turns"] and [tuple(t) for t in r["turns"]]) for r in chat.canonical_json(df).collect()}
    assert got == {i: (layout, turns) for i, _, layout, turns in RECORDS}


def test_typed_tables(spark):
    df = spark.createDataFrame([(1, "i", None, "o"), (2, "i", "n", None)], "conv_id long, instruction string, input string, output string").withColumn("turns", F.lit(1))
    got = [[tuple(t) for t in r["turns"]] for r in chat.canonical(df).orderBy("conv_id").collect()]
    assert got == [[("user", "i"), ("assistant", "o")], [("user", "i\n\nn"), ("assistant", "")]]
    with pytest.raises(ValueError, match="no layout"):
        chat.canonical(df.select("conv_id", "input"))


def test_every_text_comes_back(spark):
    rnd = random.Random(7)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[SAYS]", "[/ROLE]", "\\", "<", "[", "/", "s>", "INST]", "a", "\n", "$1", "é👍", ""]
    text = lambda: "".join(rnd.choice(bits) for _ in range(rnd.randrange(12)))
    rows = [(c, t if rnd.random() > .1 else None, rnd.choice(["user", "assistant", "system", None, "", text()]), rnd.choice([None, text(), text()]))
            for c in range(200) for t in range(rnd.randrange(1, 6))] + [(None, 0, "user", "x" * 300_000 + "[INST]"), (500, 1, "user", "a"), (500, 1, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    df = df.withColumn("turns", F.lit("clash")).withColumn("segments", F.lit("clash")).withColumn("layout", F.lit("clash"))
    back = chat.read_back(chat.format_chats(chat.canonical(df)))
    want = defaultdict(list)
    for c, t, role, said in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want[c].append((role or "", said or ""))
    got = {r["conv_id"]: r for r in back.collect()}
    assert {c: [tuple(t) for t in r["turns"]] for c, r in got.items()} == want
    assert {c: r["loss_text"] for c, r in got.items()} == {c: "".join(x for role, x in t if role == "assistant") for c, t in want.items()}
    control = re.compile(r"</?s>|\[/?INST\]|\[/?ROLE\]|\[SAYS\]")
    for c, r in got.items():         # no control string but the template's own
        own = sum({"user": 2, "assistant": 2}.get(role, 3) for role, _ in want[c])
        assert len(control.findall(r["formatted"])) == own


def test_chat_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digest(chat.read_back(chat.format_chats(chat.canonical(none)))).count() == 0
