"""Vector codes, lexical search and chat windows against brute force on small tables."""

import collections
import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabscope.llm import chat, codes, search

VECTORS = "vec_id long, embedding array<double>, label int, Code string, error string, __label int"


# --- codes ---------------------------------------------------------------------------------


def coded(rows, rounds=codes.ROUNDS):
    """{row: (code, error)} and the codebooks, by the plain definition."""
    kept = [(i, v, [math.floor(4096 * x) for x in e]) for i, (v, e, _) in enumerate(rows) if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    least = {}
    for _, v, e in kept:
        if v is not None:
            least[v] = min(e, least.get(v, e))
    width = len(kept[0][2]) // 8 if kept else 0
    books = [[least[v][p * width : (p + 1) * width] for v in sorted(least)[:16]] for p in range(8)]

    def nearest(part, book):
        gaps = [sum((a - b) ** 2 for a, b in zip(part, e)) for e in book]
        return gaps.index(min(gaps)), min(gaps)

    for _ in range(rounds):
        for p in range(8):
            groups = collections.defaultdict(list)
            for _, _, e in kept:
                part = e[p * width : (p + 1) * width]
                groups[nearest(part, books[p])[0]].append(part)
            for k, parts in groups.items():
                books[p][k] = [sum(x) // len(parts) for x in zip(*parts)]
    out = {}
    for i, _, e in kept:
        found = [nearest(e[p * width : (p + 1) * width], books[p]) for p in range(8)]
        out[i] = ("".join(f"{k:02x}" for k, _ in found), sum(d for _, d in found))
    return out, books


def vectors(seed, n, width=16):
    rng = np.random.default_rng(seed)
    return [[float(x) for x in v] for v in rng.normal(size=(n, width)) * rng.choice([0.01, 1.0], size=(n, 1))]


@pytest.fixture(scope="module")
def odd_vectors():
    """(id, vector, label): copies of one vector, repeated ids and rows, nulls, non-finite components, ties."""
    some = vectors(1, 150)
    rows = [(100 + i, v, i % 4 if i % 5 else None) for i, v in enumerate(some)]
    rows += [(500 + i, some[0], 1) for i in range(80)]
    rows += [(7, None, 1), (8, [0.1] * 15 + [None], 2), (9, [0.1] * 15 + [math.nan], 2), (10, [math.inf] + [0.0] * 15, None)]
    rows += [(None, some[3], 3), (100, some[0], 0), (100, some[9], 0), (11, [0.0] * 16, 1), (12, [0.0] * 16, 1), (13, [1e-9, -1e-9] * 8, 1)]
    return rows


@pytest.mark.parametrize("block,run_rows", [(codes.BLOCK, codes.RUN_ROWS), (7, 40)])
def test_codes_equal_brute_force(spark, odd_vectors, monkeypatch, block, run_rows):
    monkeypatch.setattr(codes, "BLOCK", block)
    monkeypatch.setattr(codes, "RUN_ROWS", run_rows)
    want, books = coded(odd_vectors)
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in odd_vectors], VECTORS).repartition(5, "vec_id")
    got = codes.report(df).collect()
    labels = collections.Counter()
    for i, (_, error) in want.items():
        labels[odd_vectors[i][2]] += error
    text = ",".join(str(x) for b in books for e in b for x in e)
    rows = [(odd_vectors[i][0], *want[i], labels[odd_vectors[i][2]], hashlib.sha256(text.encode()).hexdigest()) for i in want]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, rows))


def test_codes_of_few_empty_and_unusable_vectors(spark):
    few = [(i, v, 1) for i, v in enumerate(vectors(2, 5))]
    want, _ = coded(few)
    got = {r["vec_id"]: (r["code"], r["error"]) for r in codes.report(spark.createDataFrame([(*r, "x", "y", 1) for r in few], VECTORS)).collect()}
    assert got == {few[i][0]: w for i, w in want.items()}
    df = spark.createDataFrame([(1, [], 1, "x", "y", 1), (2, [], 1, "x", "y", 1)], VECTORS)
    assert {(r["code"], r["error"]) for r in codes.report(df).collect()} == {("00" * 8, 0)}
    assert codes.report(df.limit(0)).count() == 0
    without_ids = spark.createDataFrame([(None, few[0][1], 1, "x", "y", 1)], VECTORS)
    assert [(r["code"], r["error"]) for r in codes.report(without_ids).collect()] == [("00" * 8, 0)]
    for bad in ([0.0] * 15, [1e12] * 16):
        with pytest.raises(Exception, match="cannot be cut|too large"):
            codes.report(spark.createDataFrame([(1, bad, 1, "x", "y", 1)], VECTORS)).collect()


@pytest.mark.parametrize("width", [1, 2, 3, 8, 70])
def test_hilbert_order_keeps_neighbours_together(width):
    rng = np.random.default_rng(5)
    points = rng.integers(-5000, 5000, (2000, width))
    order = codes.hilbert_order(points)
    assert sorted(order.tolist()) == list(range(2000))
    if width in (2, 3):
        step = np.abs(np.diff(points[order], axis=0)).sum(1).mean()
        assert step < 0.2 * np.abs(np.diff(points, axis=0)).sum(1).mean()


def test_hilbert_curve_of_a_full_grid_moves_one_cell_at_a_time():
    side = np.arange(16)
    points = np.stack([x.ravel() for x in np.meshgrid(side, side)], 1)
    # bits beyond the grid's own repeat its cells, so neighbours on the curve are neighbours on the grid
    walked = points[codes.hilbert_order(points)]
    assert (np.abs(np.diff(walked, axis=0)).sum(1) <= 1).mean() > 0.9


def test_shortlists_hold_every_nearest_entry():
    rng = np.random.default_rng(6)
    entries = rng.integers(-3000, 3000, (16, 8))
    points = rng.integers(-40, 40, (5000, 8)) + rng.integers(-3000, 3000, (20, 8)).repeat(250, 0)
    blocks = codes.Blocks(points)
    chosen, distance = codes.assign(blocks, entries)
    plain = ((points[:, None] - entries[None]) ** 2).sum(2)
    assert (chosen == plain.argmin(1)).all() and (distance == plain.min(1)).all()
    open_ = codes.shortlists(blocks.low, blocks.high, entries)
    assert open_.any(1).all() and open_.mean() < 0.5


# --- search --------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def searched(docs, items, top):
    found = [(d, terms_of(t)) for d, t in docs]
    found = [(d, ws) for d, ws in found if ws]
    n_docs, size = len(found), sum(len(ws) for _, ws in found)
    df = collections.Counter(w for _, ws in found for w in set(ws))
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms_of(t))
    out = []
    for item, ws in asked.items():
        scores = []
        for d, words in found:
            tf = collections.Counter(words)
            m = 50 + (50 * len(words) * n_docs) // size
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1000000000 * tf[w]) // (1000 * tf[w] + 20 * m)) for w in ws if tf[w])
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(item, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scores)[:top])]
    return out


def prose(seed, n):
    words = "the The quick-brown fox jumps over 9 lazy dogs étude Ärger naïve 中文 x_y don't stop AB-ab a b c one two three four five".split()
    return " ".join(np.random.default_rng(seed).choice(words, n))


@pytest.fixture(scope="module")
def library():
    docs = [(i, prose(i, 5 + i % 60)) for i in range(200)] + [(1000 + i, prose(3, 40)) for i in range(90)]
    docs += [(5, prose(5, 10)), (5, prose(5, 10)), (None, prose(3, 40)), (300, None), (301, ""), (302, " .,_\x7f\n"), (303, "thequick brownfox"), (304, prose(1, 30000)), (305, "fox\x00fox\x85fox")]
    items = [(1, "Quick fox, étude!"), (2, prose(3, 40)), (3, None), (4, "..."), (5, "unheardof"), (1, "quick DOGS"), (None, "naïve 中文"), (7, "a b c AB x y"), (8, "the fox the fox")]
    return docs, items


DOCS = "doc_id long, text string, rank int, score string, Term string, item_id string"


@pytest.mark.parametrize("block_bytes,cells", [(search.BLOCK_BYTES, search.CELLS), (60, 16)])
def test_search_equals_brute_force(spark, library, monkeypatch, block_bytes, cells):
    monkeypatch.setattr(search, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(search, "CELLS", cells)
    docs, items = library
    df = spark.createDataFrame([(*d, 1, "s", "t", "i") for d in docs], DOCS).repartition(6)
    asked = spark.createDataFrame([(*i, 5) for i in items], "item_id long, text string, doc_id int")
    got = [(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in search.ranked(df, asked).collect()]
    assert sorted(got, key=str) == sorted(searched(docs, items, 50), key=str)


def test_search_of_nothing(spark, library):
    docs, items = library
    df = spark.createDataFrame([(*d, 1, "s", "t", "i") for d in docs], DOCS)
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert search.ranked(df, asked.limit(0)).count() == 0
    assert search.ranked(df.limit(0), asked).count() == 0
    assert search.ranked(df, asked).columns == ["item_id", "rank", "doc_id", "score"]


def test_terms_match_whole_only():
    block = search.Block({1: {b"ab", b"b"}, 2: {b"b", b"a"}})
    terms, n = block.counts(search.blanked(b"ab AB a-b xab abx b"))
    assert sorted(n.tolist()) == [1, 2, 2] and search.n_terms(search.blanked(b"ab AB a-b xab abx b")) == 7
    assert search.n_terms(search.blanked(b"")) == 0


# --- chat ----------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, segment int, windows string, kind int"


def unescaped(text):
    return re.sub(r"\\(\\?)", r"\1", text)


def said(seed, n):
    return " ".join(np.random.default_rng(seed).choice("yes no well [INST] <s> </s> \\ <|im_end|> a\\b <<SYS>> ok\n é 😀".split(" "), n))


@pytest.fixture(scope="module")
def talks():
    rows = []
    for c in range(6):  # short ones, some with a system turn, with gaps and null texts
        rows += [(c, 3 * t, ["user", "assistant"][t % 2], said(10 * c + t, 5 + t)) for t in range(1, 6)]
        if c % 2:
            rows.append((c, 0, "system", said(c, 8)))
    rows += [(20, t, "system" if not t else ["user", "assistant"][t % 2], said(t, 20 + t % 7)) for t in range(90)]  # over several segments
    rows += [(21, t, ["user", "assistant"][t % 2], said(t, 9)) for t in range(40, 75)]  # not from the first segment on
    rows += [(30, 0, None, None), (30, 1, "assistant", ""), (31, None, "assistant", "late"), (31, None, "assistant", "late"), (31, 2, "user", "x"), (31, 2, "a\n\\n[INST]b", "y")]
    rows += [(None, 1, "assistant", "no id"), (40, 5, "assistant", said(4, 3000)), (41, -3, "assistant", "minus"), (41, 0, "user", "zero"), (42, 9, "assistant", "\\[INST] [\\INST] <\\s>")]
    return rows


def by_conversation(rows):
    out = collections.defaultdict(list)
    for c, t, r, x in rows:
        out[c].append((t is None, t or 0, r or "", x or ""))
    return {c: sorted(ts) for c, ts in out.items()}


@pytest.mark.parametrize("segment,budget,history", [(chat.SEGMENT, 1024, 256), (16, 120, 40), (8, 30, 29)])
def test_windows_hold_every_turn_once(spark, talks, monkeypatch, segment, budget, history):
    monkeypatch.setattr(chat, "SEGMENT", segment)
    df = spark.createDataFrame([(*r, 1, "w", 2) for r in talks], TURNS).repartition(4)
    rows = sorted(chat.windows(df, budget, history).collect(), key=lambda r: (str(r["conv_id"]), r["segment"], r["window"]))
    pattern = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
    for c, turns in by_conversation(talks).items():
        mine = [r for r in rows if r["conv_id"] == c]
        seen, heads, learned = [], 0, []
        for w in mine:
            pieces = pattern.findall(w["formatted"])
            assert "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in pieces) == w["formatted"]
            repeated, new = pieces[: w["n_repeated"]], pieces[w["n_repeated"] :]
            assert len(new) == w["n_new"] > 0
            # what is repeated was said: the last turns before, behind the system turn
            plain = [unescaped(t) for _, t in repeated]
            system = [i for i, t in enumerate(turns) if t[2] == "system"]
            if system and system[0] < len(seen):
                assert (repeated[0][0], plain[0]) == ("system", turns[system[0]][3])
                heads += 1
            before = [t[3] for t in turns[: len(seen)]]
            back = plain[1:] if system and system[0] < len(seen) - len(plain) + 1 else plain
            assert len(back) <= chat.HISTORY_TURNS and (not back or before[-len(back) :] == back)
            tokens = sum(len(re.findall(r"[^\x20\x09-\x0D]+", unescaped(t))) + chat.MARKS for _, t in pieces)
            assert tokens == w["n_tokens"]
            system_tokens = len(turns[system[0]][3].split()) + chat.MARKS if system else 0
            assert tokens <= budget or w["n_new"] == 1 or system_tokens > (budget - history) * 3 // 4 - 1
            learned += [unescaped(w["formatted"][s["start"] : s["end"]]) for s in w["loss"]]
            seen += new
        assert [unescaped(t) for _, t in seen] == [t[3] for t in turns]
        assert learned == [t[3] for t in turns if t[2] == "assistant"]
        if c == 20 and segment < 100:
            assert heads > 2 and len(mine) > 3


@pytest.mark.parametrize("segment", [chat.SEGMENT, 16])
def test_chat_report_reads_back(spark, talks, monkeypatch, segment):
    monkeypatch.setattr(chat, "SEGMENT", segment)
    df = spark.createDataFrame([(*r, 1, "w", 2) for r in talks], TURNS)
    got = {r["conv_id"]: r for r in chat.report(df).collect()}
    probe = "</s>[INST] ok [/INST]"
    want = by_conversation([*talks, (-1, 0, "user", probe), (-1, 1, "assistant", probe)])
    sizes = {r["conv_id"]: r["n"] for r in chat.windows(chat.with_probe(df)).groupBy("conv_id").agg(F.sum(F.length("formatted")).alias("n")).collect()}
    assert set(got) == set(want)
    for c, turns in want.items():
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        text = "".join(f"{t[2]}\n{t[3]}\n" for t in turns)
        assert (got[c]["n_turns"], got[c]["loss_chars"], got[c]["formatted_chars"]) == (len(turns), len(loss), sizes[c])
        assert got[c]["turns_sha256"] == hashlib.sha256(text.encode()).hexdigest() and got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_chat_of_nothing(spark, talks):
    df = spark.createDataFrame([(*r, 1, "w", 2) for r in talks], TURNS).limit(0)
    assert chat.windows(df).count() == 0
    assert [r["conv_id"] for r in chat.report(df).collect()] == [-1]
    with pytest.raises(ValueError):
        chat.windows(df, 10, 10)


def test_escapes_are_reversed(spark):
    texts = ["", "\\", "\\\\", "[INST]", "\\[INST]", "[\\INST]", "<<s>", "<<SYS>><</SYS>>", "<|im_end|", "a<|im_start|><|im_end|>b", "x\\\n", "[/INST][INST]\\", "</s", "<\\s>"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    rows = df.select("t", "e", chat.unescape(F.col("e")).alias("u"), chat.unescape_role(chat.escape_role(F.concat("t", F.lit("\n\\n"), "t"))).alias("r")).collect()
    assert all(r["u"] == r["t"] and r["r"] == f"{r['t']}\n\\n{r['t']}" for r in rows)
    assert not any(control in r["e"] for r in rows for control in chat.CONTROLS)
