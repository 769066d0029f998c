"""Chat formatting with column expressions only: turn-aligned windows of bounded size, with a loss mask.

Turns of a conversation stand in order of turn, role, text (null turns last). A segment holds the
turns whose number lies in one range of ``SEGMENT``, so a conversation of any length is spread over
groups of bounded size. Prefix sums of turn tokens choose its windows: a window takes whole turns
while they fit the budget left by the system turn and the history; a turn larger than that is a
window of its own. Every later window starts with the system turn (the first row of that role, once
it has been said) and with the last turns before it that fit the history, also those of the segment
before. Only assistant texts that are new in a window count for the loss; repeated ones are masked.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. A backslash in a text is doubled, and
one is set behind the first character of every control string, so no text can end its turn; line
breaks in a role become ``\\n``. ``read_back`` undoes this.

Edge cases: null texts and roles are empty; conversations of null id form one; a turn without words
has the tokens of its marks; repeated rows and turns of one number stay, in the order above; extra
columns are not read; an empty table gives no windows. Rows that share a conversation and a range of
``SEGMENT`` turn numbers are gathered in one row, so only repeated turn numbers can make it larger.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEGMENT = 1024  # turn numbers of a group; a window does not cross its end, history does
BUDGET = 1024  # tokens of a window
HISTORY = 256  # tokens of repeated turns before the new ones, at most
HISTORY_TURNS = 4
MARKS = 4  # tokens of a turn's marks
START, END = "<|im_start|>", "<|im_end|>"
ROLE_SYSTEM, ROLE_LOSS = "system", "assistant"

# fixed values: strings that chat templates in use give a meaning of their own
CONTROLS = (START, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = r"[<\[](?=\|im_start\|>|\|im_end\|>|/?s>|/?INST\]|</?SYS>>)"
_TOKEN = r"[^\x20\x09-\x0D]+"

_TURN = "struct<turn:bigint,role:string,text:string>"
_OWN, _HISTORY, _SYSTEM, _MARKER = range(4)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def escape(text: Column) -> Column:
    """No control string is left; the other characters stay in order."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.when(text.rlike(r"[\\<\[]"), F.regexp_replace(doubled, _CONTROL, r"$0\\")).otherwise(text)


def unescape(text: Column) -> Column:
    return F.when(text.contains("\\"), F.regexp_replace(text, r"\\(\\?)", "$1")).otherwise(text)


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    """A backslash is doubled or stands before a control string's second character or an n."""
    return unescape(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def n_tokens(text: Column) -> Column:
    return (F.regexp_count(text, F.lit(_TOKEN)) + MARKS).cast("long")


def with_probe(conversations: DataFrame) -> DataFrame:
    """The given turns, and conversation -1, whose texts are made of another template's control strings."""
    said = "</s>[INST] ok [/INST]"
    probe = conversations.sparkSession.createDataFrame(
        [(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(probe)


def segments(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, history_turns: int = HISTORY_TURNS) -> DataFrame:
    """conv_id, segment, alone (the conversation has no other), windows: array of structs, a row per segment.

    Turns move once. Behind them go copies of the last turns of a segment for the next one, of the
    system turn for the later segments of its conversation, and a mark in segment 0 that there are more.
    """
    if history >= budget:
        raise ValueError("the history must be smaller than the budget")
    none = F.lit(1 << 40)  # segment of turns without a number, after all others
    turns = conversations.select(
        "conv_id", F.coalesce(F.floor(F.col("turn") / SEGMENT).cast("long"), none).alias("segment"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    last = F.when((F.pmod("turn", F.lit(SEGMENT)) >= SEGMENT - history_turns) & (F.col("segment") < none), F.lit(_HISTORY))
    rows = turns.withColumn("kind", F.explode(F.filter(F.array(F.lit(_OWN), last), lambda k: k.isNotNull())))
    rows = rows.withColumn("segment", F.when(F.col("kind") == _HISTORY, F.col("segment") + 1).otherwise(F.col("segment")))

    parts = turns.filter(F.col("segment") != 0).select("conv_id", "segment").distinct()
    split = parts.select("conv_id").distinct()
    markers = split.select("conv_id", F.lit(0).cast("long").alias("segment"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(_MARKER).alias("kind"))
    system = turns.filter(F.col("role") == ROLE_SYSTEM).join(split.withColumnRenamed("conv_id", "__c"), F.col("conv_id").eqNullSafe(F.col("__c")), "left_semi")
    system = system.groupBy("conv_id").agg(F.min(F.struct(F.coalesce("turn", F.lit((1 << 63) - 1)).alias("turn"), "role", "text", "segment")).alias("said"))
    system = system.select(F.col("conv_id").alias("__c"), "said")
    system = parts.join(system, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("segment") > F.col("said.segment")))
    system = system.select("conv_id", "segment", F.col("said.turn").alias("turn"), F.col("said.role").alias("role"), F.col("said.text").alias("text"), F.lit(_SYSTEM).alias("kind"))

    rows = reduce(DataFrame.unionByName, (rows, markers, system))
    turn = F.struct("turn", "role", "text")
    groups = rows.groupBy("conv_id", "segment").agg(
        *(F.collect_list(F.when(F.col("kind") == k, turn)).alias(name) for k, name in ((_OWN, "own"), (_HISTORY, "before"), (_SYSTEM, "system"))),
        F.count(F.when(F.col("kind") == _MARKER, 1)).alias("more"))
    groups = groups.filter(F.size("own") > 0)
    return groups.select("conv_id", "segment", ((F.col("segment") == 0) & (F.col("more") == 0)).alias("alone"), _windows(budget, history, history_turns).alias("windows"))


def _windows(budget: int, history: int, history_turns: int) -> Column:
    def order(a: Column, b: Column) -> Column:
        after = F.lit(0)
        for name in ("text", "role", "turn"):
            x, y = a[name], b[name]
            if name == "turn":
                x, y = F.coalesce(x, F.lit((1 << 63) - 1)), F.coalesce(y, F.lit((1 << 63) - 1))
            after = F.when(x < y, -1).when(x > y, 1).otherwise(after)
        return after

    ready = F.struct(
        F.array_sort("own", order).alias("own"), F.slice(F.reverse(F.array_sort("before", order)), 1, history_turns).alias("late"), F.col("system").alias("system"))

    def over(group: Column) -> Column:
        late = F.reverse(group["late"])
        skip = F.size(late)  # places before the first own turn
        return _let(F.concat(late, group["own"]), lambda turns: _let(F.transform(turns, lambda t: n_tokens(t["text"])), lambda sizes: cut(turns, sizes, skip, group["system"])))

    def cut(turns: Column, sizes: Column, skip: Column, system: Column) -> Column:
        # place of the system turn among the turns, 0 if it was said before them, null if there is none
        own_system = F.array_position(F.transform(turns, lambda t: t["role"]), ROLE_SYSTEM)
        at = F.when(F.size(system) > 0, F.array_position(turns, F.try_element_at(system, F.lit(1)))).when(own_system > 0, own_system)
        head = F.when(F.size(system) > 0, F.element_at(system, 1)).when(own_system > 0, F.element_at(turns, own_system.cast("int")))
        room = F.greatest(F.lit(budget - history) - F.coalesce(n_tokens(head["text"]), F.lit(0)), F.lit((budget - history) // 4)).cast("long")
        sums = F.aggregate(sizes, F.array(F.lit(0).cast("long")), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))  # sums[i]: tokens before place i, from 0
        return _let(F.struct(sums.alias("sums"), room.alias("room"), at.alias("at"), head.alias("head")), lambda s: F.transform(
            starts(s["sums"], s["room"], skip, F.size(turns)), lambda span: window(turns, s, span)))

    def starts(sums: Column, room: Column, skip: Column, n: Column) -> Column:
        """(first, end) of each window, places from 0."""
        def step(acc: Column, i: Column) -> Column:  # the turn at place i joins the open window or begins one
            fits = F.element_at(sums, i + 2) - F.element_at(sums, acc["first"] + 1) <= room
            return F.when(fits, acc).otherwise(F.struct(i.alias("first"), F.concat(acc["done"], F.array(F.struct(acc["first"].alias("first"), i.alias("end")))).alias("done")))

        begin = F.struct(skip.alias("first"), F.array().cast("array<struct<first:int,end:int>>").alias("done"))
        rest = F.filter(F.sequence(skip, n - 1), lambda i: i > skip)
        return F.aggregate(rest, begin, step, lambda acc: F.concat(acc["done"], F.array(F.struct(acc["first"].alias("first"), n.alias("end")))))

    def window(turns: Column, s: Column, span: Column) -> Column:
        first, end, sums = span["first"], span["end"], s["sums"]
        # sums only grow, so the history is a run of places up to the first new one
        back = F.slice(sums, F.greatest(first - history_turns, F.lit(0)) + 1, F.least(first, F.lit(history_turns)))
        n_before = F.size(F.filter(back, lambda p: F.element_at(sums, first + 1) - p <= history))
        begin = first - n_before
        with_head = F.coalesce(s["at"] <= begin, F.lit(False))
        shown = F.concat(F.when(with_head, F.array(s["head"])).otherwise(F.array().cast(f"array<{_TURN}>")), F.slice(turns, begin + 1, end - begin))
        repeated = n_before + with_head.cast("int")
        tokens = F.element_at(sums, end + 1) - F.element_at(sums, begin + 1) + F.when(with_head, n_tokens(s["head"]["text"])).otherwise(0)
        return _let(F.transform(shown, _turn_text), lambda pieces: F.struct(
            repeated.alias("n_repeated"), (end - first).alias("n_new"), tokens.alias("n_tokens"),
            F.concat_ws("", F.transform(pieces, lambda p: F.concat(p["mark"], p["text"], F.lit(END + "\n")))).alias("formatted"),
            _loss(pieces, repeated).alias("loss")))

    return _let(ready, over)


def _turn_text(turn: Column) -> Column:
    return F.struct(
        F.concat(F.lit(START), escape_role(turn["role"]), F.lit("\n")).alias("mark"), escape(turn["text"]).alias("text"), (turn["role"] == ROLE_LOSS).alias("target"))


def _loss(pieces: Column, repeated: Column) -> Column:
    """Spans [start, end) in code points of the formatted text: texts of new assistant turns."""
    sizes = F.transform(pieces, lambda p, i: F.struct(
        F.length(p["mark"]).cast("long").alias("mark"), F.length(p["text"]).cast("long").alias("text"), (p["target"] & (i >= repeated)).alias("target")))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def add(acc: Column, p: Column) -> Column:
        start = acc["pos"] + p["mark"]
        span = F.array(F.struct(start.alias("start"), (start + p["text"]).alias("end")))
        return F.struct((start + p["text"] + len(END) + 1).alias("pos"), F.when(p["target"], F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(sizes, F.struct(F.lit(0).cast("long").alias("pos"), none.alias("out")), add, lambda acc: acc["out"])


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, history_turns: int = HISTORY_TURNS) -> DataFrame:
    """A row per window: conv_id, segment, window, n_repeated (turns at its head that are not new), n_new, n_tokens, formatted, loss."""
    made = segments(conversations, budget, history, history_turns)
    return made.select("conv_id", "segment", F.posexplode("windows").alias("window", "w")).select("conv_id", "segment", "window", "w.*")


def read_back(formatted: Column) -> Column:
    """Turns of a formatted text, unescaped: array<struct<role,text>>."""
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda p: p != "")
    line = F.lit("\n")

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        return F.struct(
            unescape_role(F.substr(role, F.lit(len(START) + 1))).alias("role"), unescape(F.substr(piece, F.instr(piece, line) + 1)).alias("text"))

    return F.transform(pieces, turn)


def _read(windows: Column) -> Column:
    """What a segment's windows say: the new turns, the text under the mask, code points."""
    def one(w: Column) -> Column:
        return _let(read_back(w["formatted"]), lambda turns: F.struct(
            F.concat_ws("", F.transform(F.slice(turns, w["n_repeated"] + 1, F.greatest(F.size(turns) - w["n_repeated"], F.lit(0))), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))).alias("turns"),
            (F.size(turns) - w["n_repeated"]).cast("long").alias("n_turns"),
            F.concat_ws("", F.transform(w["loss"], lambda s: unescape(F.substr(w["formatted"], (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))).alias("loss"),
            F.length(w["formatted"]).cast("long").alias("n_chars")))

    return _let(F.transform(windows, one), lambda ws: F.struct(
        F.concat_ws("", ws["turns"]).alias("turns"), _total(ws["n_turns"]).alias("n_turns"), F.concat_ws("", ws["loss"]).alias("loss"), _total(ws["n_chars"]).alias("n_chars"),
        F.size(ws).cast("long").alias("n_windows")))


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, b: a + b)


def report(conversations: DataFrame) -> DataFrame:
    """Counts and digests read back from the formatted windows, a row per conversation.

    A digest needs a conversation's text in one place. Conversations of one segment have it there
    already; only those of more are brought together by their id, whole.
    """
    found = segments(with_probe(conversations)).select("conv_id", "segment", "alone", _read(F.col("windows")).alias("r"))
    parts = F.array_sort(F.collect_list(F.struct("segment", "r")))
    rest = found.filter(~F.col("alone")).groupBy("conv_id").agg(parts.alias("parts"))
    joined = F.struct(
        F.concat_ws("", F.transform("parts", lambda p: p["r"]["turns"])).alias("turns"), _total(F.transform("parts", lambda p: p["r"]["n_turns"])).alias("n_turns"),
        F.concat_ws("", F.transform("parts", lambda p: p["r"]["loss"])).alias("loss"), _total(F.transform("parts", lambda p: p["r"]["n_chars"])).alias("n_chars"),
        _total(F.transform("parts", lambda p: p["r"]["n_windows"])).alias("n_windows"))
    every = found.filter("alone").select("conv_id", "r").unionByName(rest.select("conv_id", joined.alias("r")))
    return every.select(
        "conv_id", F.col("r.n_turns").alias("n_turns"), F.sha2("r.turns", 256).alias("turns_sha256"), F.length("r.loss").cast("long").alias("loss_chars"),
        F.sha2("r.loss", 256).alias("loss_sha256"), F.col("r.n_chars").alias("formatted_chars"), F.col("r.n_windows").alias("n_windows"))
