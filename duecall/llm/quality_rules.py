"""Quality rules learned as a decision list, and applied as Spark expressions.

Every number of a text is a native column expression. Sequential covering learns the list from
label counts per cell of binned numbers: a rule starts empty, takes the threshold condition with
the largest information gain until it meets no good document or gains nothing, loses trailing
conditions that do not help on rows held out for pruning, and is kept if it is precise enough
there. Rows it covers are taken out and the next rule is grown. The list becomes one ordered
``CASE WHEN`` that gives the number of the first rule a text meets.

Learning reads texts of a bounded sample of labelled rows (``LABELLED_BOUND``); what comes to the
driver are counts, at most one row per cell: 2 x 6^6 rows, whatever the input.

Cases: a null text counts as empty; a text without a word has zeros throughout. Blanks, tabs and
line ends divide words. Without labels, or without a bad one, the list is empty and only the base
rule rejects. Ties between conditions go to the first feature and smallest threshold. Repeated rows
are judged alike. Columns of the input named like a result column are replaced by it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duecall.functions.fence import fenced
from duecall.llm.shared import LABELLED_BOUND, free_prefix, labelled_sample

_BLANK = r"[\\x20\\x09-\\x0D]"
NUMBERS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_HELPERS = ("n_lines", "n_upper")

# Feature: expression over the numbers, and the thresholds at which it is cut.
FEATURES: dict[str, tuple[str, tuple[float, ...]]] = {
    "words": ("n_words", (80, 150, 300, 1000, 5000)),
    "mean_word": ("word_chars / greatest(n_words, 1)", (3.0, 4.0, 5.0, 7.0, 9.0)),
    "symbol_share": ("n_symbols / greatest(n_words, 1)", (0.02, 0.1, 0.3, 0.6, 1.0)),
    "dup_line_share": ("n_dup_lines / greatest(n_lines, 1)", (0.05, 0.1, 0.2, 0.3, 0.5)),
    "repeat_share": ("n_repeat_words / greatest(n_words, 1)", (0.05, 0.1, 0.2, 0.3, 0.4)),
    "upper_share": ("n_upper / greatest(word_chars, 1)", (0.05, 0.1, 0.2, 0.4, 0.7)),
}


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns of ``NUMBERS`` and the helper columns ``n_lines``, ``n_upper``.

    ``n_repeat_words`` counts the words that lie in a 3-word window found twice or more in the
    text: windows are sorted by hash next to their position, so the cost is that of one sort.
    """
    taken = {*NUMBERS, *_HELPERS}
    kept = [c for c in docs.columns if c not in taken]
    p = free_prefix(docs)
    base = docs.withColumn(f"{p}t", F.coalesce(F.col(f"`{text}`"), F.lit("")))
    words = base.withColumns(
        {
            f"{p}w": F.expr(f"array_remove(split({p}t, '{_BLANK}+'), '')"),
            f"{p}l": F.expr(f"filter(split({p}t, '\\n'), l -> rlike(l, '[^{_BLANK[1:-1]}]'))"),
            "word_chars": F.expr(f"length(regexp_replace({p}t, '{_BLANK}+', ''))"),
            "n_symbols": F.expr(f"length({p}t) - length(translate({p}t, '#*$%&|<>', ''))"),
            "n_upper": F.expr(f"length({p}t) - length(regexp_replace({p}t, '[A-Z]+', ''))"),
        }
    )
    windows = words.withColumns(
        {
            "n_words": F.expr(f"size({p}w)"),
            "n_lines": F.expr(f"size({p}l)"),
            "n_dup_lines": F.expr(f"size({p}l) - size(array_distinct({p}l))"),
            f"{p}s": F.expr(
                f"""sort_array(if(size({p}w) < 3, array(), transform(sequence(0, size({p}w) - 3),
                i -> struct(xxhash64(get({p}w, i), get({p}w, i + 1), get({p}w, i + 2)) as h, i as i))))"""
            ),
        }
    )
    repeats = windows.withColumn(
        f"{p}p",
        F.expr(
            f"""sort_array(transform(filter({p}s, (x, k) ->
            x.h = get({p}s, k - 1).h or x.h = get({p}s, k + 1).h), x -> x.i))"""
        ),
    )
    covered = F.expr(
        f"""aggregate(transform({p}p, (p, k) -> if(k = 0, 3, least(3, p - get({p}p, k - 1)))),
        0L, (a, b) -> a + b)"""
    )
    # fenced: a filter on a number must not move below the steps and repeat them per element
    repeats = repeats.withColumn("n_repeat_words", covered)
    return fenced(repeats, kept, {c: F.col(c).cast("bigint") for c in (*NUMBERS, *_HELPERS)})


def base_failed() -> Column:
    """Too few words, or more than half of the words in repeated windows."""
    return F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def __str__(self) -> str:
        return f"({FEATURES[self.feature][0]}) {'>=' if self.at_least else '<'} {self.threshold}"


def _count_cells(measured: DataFrame, label: str, fold: Column) -> list:
    """Good and bad rows per cell of binned features and part (grow or prune)."""
    bins = [
        F.expr("+".join(f"int(({value}) >= {t})" for t in cuts)).alias(name)
        for name, (value, cuts) in FEATURES.items()
    ]
    cells = (
        measured.select(*bins, (fold % 3 == 0).alias("prune"), F.col(label).alias("label"))
        .groupBy(*FEATURES, "prune")
        .agg(
            F.sum(F.expr("int(label = 1)")).alias("good"), F.sum(F.expr("int(label <> 1)")).alias("bad")
        )
        .collect()
    )
    return [row.asDict() for row in cells]


def _meets(cell, condition: Condition) -> bool:
    cut = FEATURES[condition.feature][1].index(condition.threshold)
    return (cell[condition.feature] > cut) == condition.at_least


def _tally(cells: list, rule: list[Condition]) -> tuple[int, int]:
    met = [c for c in cells if all(_meets(c, x) for x in rule)]
    return sum(c["bad"] for c in met), sum(c["good"] for c in met)


def _tallies(cells: list) -> dict[Condition, tuple[int, int]]:
    """Bad and good rows under every single condition, from one histogram per feature."""
    found = {}
    for name, (_, cuts) in FEATURES.items():
        bad, good = [0] * (len(cuts) + 1), [0] * (len(cuts) + 1)
        for c in cells:
            bad[c[name]] += c["bad"]
            good[c[name]] += c["good"]
        for k, cut in enumerate(cuts, 1):
            found[Condition(name, True, cut)] = (sum(bad[k:]), sum(good[k:]))
            found[Condition(name, False, cut)] = (sum(bad[:k]), sum(good[:k]))
    return found


def _grow(cells: list, most: int) -> list[Condition]:
    rule: list[Condition] = []
    bad, good = _tally(cells, rule)
    while good and bad and len(rule) < most:
        before = math.log2(bad / (bad + good))
        gain = {
            x: b * (math.log2(b / (b + g)) - before) if b else 0.0
            for x, (b, g) in _tallies(cells).items()
        }
        best = max(gain, key=gain.get)
        if gain[best] <= 1e-9:
            break
        rule.append(best)
        cells = [c for c in cells if _meets(c, best)]
        bad, good = _tally(cells, [])
    return rule


def _prune(cells: list, rule: list[Condition]) -> list[Condition]:
    def worth(kept: list[Condition]) -> float:
        bad, good = _tally(cells, kept)
        return (bad - good) / (bad + good) if bad + good else -1.0

    # max takes the first of equals, so the shortest of equally good rules wins
    return max((rule[:n] for n in range(1, len(rule) + 1)), key=worth)


def learn_rules(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    label: str = "quality",
    key: str = "doc_id",
    bound: int = LABELLED_BOUND,
    precision: float = 0.8,
    support: int = 5,
    most_rules: int = 12,
    most_conditions: int = 3,
) -> list[list[Condition]]:
    """Ordered rules that reject; ``label`` 1 is good, anything else bad.

    Rows that fail the base rule are left out: the list refines what passes it. A rule must hold
    ``support`` bad rows and ``precision`` of them bad, both while growing and while pruning (the
    support there is a third of it).
    """
    sample = labelled_sample(labels, label, bound, key)
    if label in docs.columns:
        docs = docs.drop(label)
    # at most `bound` rows of two numbers, give or take the spread of a hash sample
    rows = docs.select(key, F.col(text).alias("text")).join(F.broadcast(sample), key)
    cells = _count_cells(
        measure(rows).where(~base_failed()), label, F.pmod(F.xxhash64(F.lit("part"), key), F.lit(9))
    )
    grow = [c for c in cells if not c["prune"]]
    prune = [c for c in cells if c["prune"]]
    rules: list[list[Condition]] = []
    while len(rules) < most_rules:
        rule = _grow(grow, most_conditions)
        if not rule:
            break
        rule = _prune(prune, rule)
        seen = [_tally(part, rule) for part in (grow, prune)]
        least = (support, max(1, support // 3))
        if any(b < n or b < precision * (b + g) for (b, g), n in zip(seen, least, strict=True)):
            break
        rules.append(rule)
        grow, prune = (
            [c for c in part if not all(_meets(c, x) for x in rule)] for part in (grow, prune)
        )
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """Number (from 1) of the first rule a measured row meets; 0 if none."""
    number = "case " + " ".join(
        f"when {' and '.join(map(str, rule))} then {k}" for k, rule in enumerate(rules, 1)
    )
    return F.expr(f"{number} else 0 end" if rules else "0")


def judge(docs: DataFrame, rules: list[list[Condition]], text: str = "text") -> DataFrame:
    """``docs`` with the numbers, ``base_failed``, ``rule`` (0: none met) and ``kept``."""
    taken = ("base_failed", "rule", "kept", "n_lines", "n_upper")
    measured = measure(docs.drop(*[c for c in taken if c in docs.columns]), text)
    return (
        measured.withColumns({"base_failed": base_failed(), "rule": verdict(rules)})
        .withColumn("kept", F.expr("not base_failed and rule = 0"))
        .drop(*_HELPERS)
    )
