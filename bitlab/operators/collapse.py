"""Collapse of nested groups: string rules as column expressions, trees as aggregates, long sequences by machines over chunks.

Column expressions are for short texts. For sequences of any length the same rules are finite-state machines
(``scan.rewrite``). Whether a group is an innermost one with bits is seen at its end only, so a first scan, from the
other end, marks such groups, and a second one rewrites them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitlab.operators.chunks import SIZE, ranked, ratio, running_sum
from bitlab.operators.scan import Cascade, Machine, rewrite
from bitlab.operators.staging import checkpointed


def simplify(text: Column) -> Column:
    """The base rule at its fixpoint: 1 if there are ones only, else 0 (also for nothing)."""
    return F.when(text.rlike("^1+$"), "1").otherwise("0")


def strip(text: Column) -> Column:
    """The bits alone."""
    return F.translate(text, "()", "")


def collapse_local(text: Column) -> Column:
    """One pass: every innermost group becomes its simplified content. Results are marked, so a pass never reads its own output."""
    return F.translate(F.regexp_replace(F.regexp_replace(text, r"\(1+\)", "u"), r"\([01]+\)", "z"), "uz", "10")


def collapse_full(text: Column, depth: int) -> Column:
    """``depth`` passes, as many as groups are nested; then all that was nested is gone."""
    for _ in range(depth):
        text = collapse_local(text)
    return text


def collapse_first(text: Column) -> Column:
    """The leftmost innermost group only becomes its simplified content."""
    group = r"^(?<p>.*?)\([01]+\)"
    ones = F.regexp_extract(text, r"\(([01]+)\)", 1).rlike("^1+$")
    return F.when(ones, F.regexp_replace(text, group, "${p}1")).otherwise(F.regexp_replace(text, group, "${p}0"))


def then_whole(text: Column) -> Column:
    """What a pass has left, simplified as a whole: the bits between parentheses become 1 if they are ones only, else 0; nothing becomes 0."""
    return F.when(text == "", "0").otherwise(F.regexp_replace(F.regexp_replace(text, "[01]*0[01]*", "0"), "1+", "1"))


def phase(text: Column, first: str) -> Column:
    """One pass of a two-phase rule: the pair ``first`` (01 or 10) becomes 0, then runs of one symbol are compressed."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, first, "0"), "0+", "0"), "1+", "1")


def collapse_e(text: Column) -> Column:
    """First 01, then 10."""
    return phase(phase(text, "01"), "10")


def collapse_i(text: Column) -> Column:
    """First 10, then 01."""
    return phase(phase(text, "10"), "01")


def collapse_frames(text: Column, suffix: bool = False) -> Column:
    """Atomic frames: 1(bits), or with ``suffix`` (bits)1, become 1 if all their bits are ones, else 0; then runs of two or more are compressed."""
    ones, any_ = (r"\(1+\)1", r"\([01]+\)1") if suffix else (r"1\(1+\)", r"1\([01]+\)")
    t = F.translate(F.regexp_replace(F.regexp_replace(text, ones, "u"), any_, "z"), "uz", "10")
    return F.regexp_replace(F.regexp_replace(t, "0{2,}", "0"), "1{2,}", "1")


#: An innermost group with bits has its far end, in the direction of the second scan, marked as this symbol.
MARK = "o"
SYMBOLS = "01()"


def _moves(alphabet: str, to: int, before: str = "", **own: tuple[int, str]) -> dict[str, tuple[int, str]]:
    """Every symbol goes to state ``to`` and is written after ``before``, but for those of ``own`` (by z, u, open, close, mark)."""
    names = {"z": "0", "u": "1", "open": "(", "close": ")", "mark": MARK}
    return {c: (to, before + c) for c in alphabet} | {names[k]: v for k, v in own.items()}


def pair_to_zero(pair: str) -> Machine:
    """Left to right, ``pair`` (01 or 10) becomes 0."""
    return _one_pair(pair, "0")


def without_pair(pair: str) -> Machine:
    """Left to right, ``pair`` (01 or 10) goes."""
    return _one_pair(pair, "")


def _one_pair(pair: str, by: str) -> Machine:
    first, second = pair
    held = _moves(SYMBOLS, 0, first) | {first: (1, first), second: (0, by)}
    return Machine((_moves(SYMBOLS, 0) | {first: (1, "")}, held), ("", first))


def without_pairs() -> Machine:
    """Left to right, every 01 and 10 goes."""
    return Machine((_moves(SYMBOLS, 0, z=(1, ""), u=(2, "")), _moves(SYMBOLS, 0, "0", z=(1, "0"), u=(0, "")), _moves(SYMBOLS, 0, "1", z=(0, ""), u=(2, "1"))), ("", "0", "1"))


def squeezed() -> Machine:
    """Runs of one bit become one."""
    return Machine(tuple(_moves(SYMBOLS, 0, z=(1, "" if s == 1 else "0"), u=(2, "" if s == 2 else "1")) for s in range(3)), ("", "", ""))


def based() -> Machine:
    """Bits between parentheses become 1 if they are ones only, else 0."""
    one = {"z": (2, ""), "u": (1, "")}
    return Machine((_moves(SYMBOLS, 0, **one), _moves(SYMBOLS, 0, "1", **one), _moves(SYMBOLS, 0, "0", z=(2, ""), u=(2, ""))), ("", "1", "0"))


def marked(enter: str, leave: str) -> Machine:
    """Groups entered at ``enter`` that have bits and nothing else up to ``leave`` have that end marked."""
    plain = _moves(SYMBOLS, 0) | {enter: (1, enter)}
    empty = plain | {"0": (2, "0"), "1": (2, "1")}
    return Machine((plain, empty, empty | {leave: (0, MARK)}), ("", "", ""))


def within_groups(layers: list[Machine], first_only: bool = False) -> Machine:
    """The bits of marked groups go through the machines ``layers`` and replace the group; with ``first_only`` only in the first of them."""
    inner, alphabet = Cascade(layers), SYMBOLS + MARK
    after = len(inner.states) + 1 if first_only else 0
    moves = [_moves(alphabet, 0, mark=(1, ""))]
    for state in inner.states:
        fed = {c: inner.feed(state, c) for c in "01"}
        moves.append({c: (0, "") for c in alphabet} | {c: (1 + inner.states.index(s), t) for c, (s, t) in fed.items()} | {")": (after, inner.end(state))})
    moves.append(_moves(alphabet, len(inner.states) + 1, mark=(len(inner.states) + 1, "(")))
    return Machine(tuple(moves), ("",) * len(moves))


def groups_to_bits(first_only: bool = False) -> Machine:
    """Marked groups become 1 if they hold ones only, else 0; with ``first_only`` the first of them."""
    return within_groups([based()], first_only)


def phase_layers(first: str, then: str) -> list[Machine]:
    """A two-phase rule: one pair becomes 0 and runs are squeezed, then the other."""
    return [pair_to_zero(first), squeezed(), pair_to_zero(then), squeezed()]


def frames_to_bits(enter: str, leave: str) -> Machine:
    """A 1 and the marked group right after it become 1 if it holds ones only, else 0; other marked groups stay."""
    alphabet = SYMBOLS + MARK
    none = _moves(alphabet, 0, u=(1, ""), mark=(0, enter))
    held = _moves(alphabet, 0, "1", u=(1, "1"), mark=(2, ""))
    ones, zeros = {c: (2, "") for c in alphabet} | {"0": (3, ""), leave: (0, "1")}, {c: (3, "") for c in alphabet} | {leave: (0, "0")}
    return Machine((none, held, ones, zeros), ("", "1", "", ""))


def rewritten_groups(texts: DataFrame, layers: list[Machine], keys: tuple[str, ...] = ("seq_id",), index: str = "chunk") -> DataFrame:
    """Sequences of chunks (*keys, index, text) after the machines ``layers``, the first of which reads marked innermost groups."""
    return rewrite(checkpointed(rewrite(texts, [marked(")", "(")], keys, index, backwards=True)), layers, keys, index)


def local_passes(texts: DataFrame, passes: int = 1, keys: tuple[str, ...] = ("seq_id",), index: str = "chunk") -> DataFrame:
    """``collapse_local`` of whole sequences, so often."""
    for i in range(passes):
        texts = rewritten_groups(checkpointed(texts) if i else texts, [groups_to_bits()], keys, index)
    return texts


def frames(texts: DataFrame, suffix: bool = False) -> DataFrame:
    """``collapse_frames`` of whole sequences."""
    if suffix:  # the same from the other end
        back = rewrite(checkpointed(rewrite(texts, [marked("(", ")")])), [frames_to_bits(")", "(")], backwards=True)
        return rewrite(checkpointed(back), [squeezed()])
    return rewritten_groups(texts, [frames_to_bits("(", ")"), squeezed()])


def phases(texts: DataFrame, first: str, then: str) -> DataFrame:
    """Two-phase collapse of whole sequences of bits: ``phase`` with one pair and then with the other, as one cascade."""
    return rewrite(texts, phase_layers(first, then))


def collapse_to_end(texts: DataFrame, layers: list[Machine] | None = None, keys: tuple[str, ...] = ("seq_id",), max_passes: int = 10_000) -> DataFrame:
    """(*keys, chunk, text) after passes over all innermost groups until none with bits is left.

    The bits of a group are replaced by what ``layers`` make of them, the base rule if not given. A pass takes one level of nesting
    off, so there are as many as groups nest deep, and one more. Sequences may be cut anywhere. Raises if ``max_passes`` do not suffice.
    """
    columns, machine = [*keys, "chunk", "text"], within_groups(layers or [based()])
    for _ in range(max_passes):
        marks = checkpointed(rewrite(texts, [marked(")", "(")], keys, backwards=True).select(*columns))
        if marks.where(F.contains("text", F.lit(MARK))).isEmpty():
            return marks
        texts = checkpointed(rewrite(marks, [machine], keys).select(*columns))
    raise RuntimeError(f"groups are left after {max_passes} passes")


#: The rules that are traced: what a round does, in order.
TRACED = {"both": ["both"] * 4, "01 first": ["01", "10", "squeeze"], "10 first": ["10", "01", "squeeze"]}


def deletion_trace(texts: DataFrame, rule: str = "both", max_rounds: int = 64) -> DataFrame:
    """(seq_id, step, action, length, ratio): lengths as pairs of bits are deleted until nothing changes any more.

    texts: (seq_id, chunk, text) of bits. Rules: "both" deletes 01 and 10 in each step and squeezes runs in the last one;
    "01 first" deletes all 01, then all 10, then squeezes runs, and so on; "10 first" the other way round. Step 0 is the
    whole sequence; of the others a sequence has those that change it, numbered. ratio is the length over the one before.
    A round of several steps is one scan of all sequences, and its table is written. Raises if ``max_rounds`` do not suffice.
    """
    machines = {"both": without_pairs(), "01": without_pair("01"), "10": without_pair("10"), "squeeze": squeezed()}

    def told(df: DataFrame, first: int, actions: list[str]) -> DataFrame:
        rows = [F.struct(F.lit(first + i).alias("at"), F.lit(a).alias("action"), F.sum(F.get("lengths", F.lit(i))).alias("length")) for i, a in enumerate(actions)]
        return df.groupBy("seq_id").agg(F.array(*rows).alias("x")).select("seq_id", F.inline("x"))

    now = checkpointed(texts.select("seq_id", "chunk", "text", F.array(F.length("text").cast("long")).alias("lengths")))
    steps, at, total = told(now, 0, ["initial"]), 1, None
    for _ in range(max_rounds):
        now = checkpointed(rewrite(now, [machines[a] for a in TRACED[rule]]))
        steps, at = steps.unionByName(told(now, at, TRACED[rule])), at + len(TRACED[rule])
        was, total = total, now.agg(F.sum(F.length("text"))).first()[0]
        if total == was or not total:
            break
    else:
        raise RuntimeError(f"deletion did not settle in {max_rounds} rounds")
    if rule == "both":
        steps = steps.unionByName(told(rewrite(now, [squeezed()]), at, ["squeeze"]))
    w = Window.partitionBy("seq_id").orderBy("at")  # a row for each step
    changes = steps.withColumn("was", F.lag("length").over(w)).where("was IS NULL OR length < was")
    share = F.round(ratio(F.col("length"), F.when(F.col("was") > 0, F.col("was"))), 6)
    return changes.select("seq_id", (F.row_number().over(w) - 1).cast("int").alias("step"), "action", "length", share.alias("ratio"))


def tree_collapse(groups: DataFrame) -> DataFrame:
    """(seq_id, open_pos, value): each group's collapse over all levels; 1 if it and all within hold ones only, and any."""
    return groups.select("seq_id", "open_pos", F.when((F.col("n_zeros") == 0) & (F.col("n_ones") > 0), 1).otherwise(0).alias("value"))


def safe_cuts(deep: DataFrame, size: int) -> DataFrame:
    """(seq_id, block, chunk, start, symbols, text): blocks cut where no group is open, at the first such place after each ``size`` symbols.

    ``deep`` has pos, sym and depth (both ends of a group have its own). A block can be collapsed on its own. Where groups
    stay open for long, a block has several chunks of up to ``SIZE`` symbols; most blocks have one.
    """
    outside = (F.col("depth") == 0) | ((F.col("sym") == "(") & (F.col("depth") == 1))
    at = ranked(deep, "i").withColumn("i", F.col("i") - 1).withColumn("goal", F.floor(F.col("i") / size)).withColumn("outside", outside)
    # of the places that can be cut, the first with each goal
    nth = F.row_number().over(Window.partitionBy("seq_id", "goal", "outside").orderBy("pos"))
    cut = at.withColumn("cut", F.when(F.col("outside") & (nth == 1), 1).otherwise(0)).select("seq_id", F.col("pos").alias("place"), F.col("i").alias("pos"), "sym", "cut")
    numbered = running_sum(cut, F.col("cut"), "block")
    own = F.floor((F.col("pos") - F.col("first")) / SIZE)
    starts = numbered.groupBy("seq_id", "block").agg(F.min("pos").alias("first"))
    out = numbered.join(starts, ["seq_id", "block"]).groupBy("seq_id", "block", own.alias("chunk"))
    out = out.agg(F.min("place").alias("start"), F.count(F.lit(1)).alias("symbols"), F.sort_array(F.collect_list(F.struct("pos", "sym"))).alias("s"))
    return out.select("seq_id", "block", "chunk", "start", "symbols", F.array_join(F.transform("s", lambda x: x["sym"]), "").alias("text"))


def accumulate(iterations: int, token: str = "1") -> Column:
    """The text that the documented recurrence has accumulated after some iterations, as one expression.

    Each iteration appends the state (first "0"), wraps all so far in a group followed by ``token``,
    appends that and every state on the way while innermost groups are collapsed, and goes on with
    the flat state collapsed as a whole. Texts grow about threefold an iteration: for few of them.
    """

    def one_pass(a: Column, _: Column) -> Column:
        nested = F.contains(a["state"], F.lit("("))
        return F.struct(F.when(nested, F.concat(a["acc"], a["state"])).otherwise(a["acc"]).alias("acc"), F.when(nested, collapse_local(a["state"])).otherwise(a["state"]).alias("state"))

    def iteration(a: Column, i: Column) -> Column:
        wrapped = F.element_at(F.transform(F.array(F.concat(a["acc"], a["state"])), lambda acc: F.struct(acc.alias("acc"), F.concat(F.lit("("), acc, F.lit(f"){token}")).alias("state"))), 1)
        flat = F.aggregate(F.sequence(F.lit(0), i), wrapped, one_pass)  # groups nest one level deeper an iteration
        return F.element_at(F.transform(F.array(flat), lambda f: F.struct(F.concat(f["acc"], f["state"]).alias("acc"), simplify(strip(f["state"])).alias("state"))), 1)

    start = F.struct(F.lit("").alias("acc"), F.lit("0").alias("state"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), start, iteration)["acc"]
