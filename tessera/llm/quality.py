"""Quality rules: a learned decision list over text statistics, in Spark expressions only.

Statistics come from built-in functions, row by row, without a shuffle. The list is
learned by sequential covering on labelled statistics: a rule, a conjunction of
thresholds, grows by FOIL's gain on two thirds of the rows, is pruned on the rest, and the rows that it
covers go; rules stay as long as they are precise and cover enough. The list becomes one ordered conditional
expression, which Catalyst evaluates.

Learning takes at most ``most_rows`` labelled rows, those with the least hashes of
their ids; the rules judge every row.

Defined results: a null text has no words and fails the base rule, as any text of
fewer than 50 words; ids don't matter for the verdict, repeated rows get equal ones; label rows with a null
aren't used; without labels the list is empty and keeps what the base rule keeps; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_text

SPACES = r"[\x20\x09-\x0D]"
#: Bits of a packed window that hold its position; longer texts take a slower way.
POSITION_BITS = 20


@dataclass(frozen=True)
class Settings:
    most_rows: int = 10_000
    thresholds: int = 24
    most_conditions: int = 3
    most_rules: int = 12
    least_rows: int = 15
    least_precision: float = 0.75


def windows(words: Column) -> Column:
    """Hashes of all runs of three words."""
    last = F.size(words) - 3
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))).otherwise(F.array().cast("array<bigint>"))


def repeated(words: Column, keys: Column) -> Column:
    """Words in windows found twice or more. The upper bits of a hash and a position share an integer, so that
    one sort of integers brings equal windows together; words decide whether they are equal. Where different windows
    share those bits, or positions need more, windows are sorted by their words."""
    bits = POSITION_BITS
    place = lambda x: x.bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
    order = F.sort_array(F.transform(keys, lambda h, i: F.shiftleft(F.shiftright(h, bits), bits).bitwiseOR(i.cast("long"))))

    def alike(a: Column, b: Column) -> Column:
        return F.coalesce(F.shiftright(a, bits) == F.shiftright(b, bits), F.lit(False))

    def same(a: Column, b: Column) -> Column:
        out = alike(a, b)
        for d in range(3):
            out = out & (F.get(words, place(a) + d) == F.get(words, place(b) + d))
        return F.coalesce(out, F.lit(False))

    def of_near(s: Column) -> Column:
        mixed = F.size(F.filter(s, lambda x, j: alike(x, F.get(s, j + 1)) & ~same(x, F.get(s, j + 1)))) > 0
        hits = F.filter(s, lambda x, j: same(x, F.get(s, j - 1)) | same(x, F.get(s, j + 1)))
        return F.when(mixed, _repeated_long(words, keys)).otherwise(F.size(F.array_distinct(F.flatten(F.transform(hits, lambda x: F.array(place(x), place(x) + 1, place(x) + 2))))))

    def of_order(s: Column) -> Column:
        near = F.filter(s, lambda x, j: alike(x, F.get(s, j - 1)) | alike(x, F.get(s, j + 1)))
        return F.get(F.transform(F.array(near), of_near), 0)

    # an array of one sorted array, so that it is worked out once
    short = F.get(F.transform(F.array(order), of_order), 0)
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), 0).when(F.size(keys) < 1 << bits, short).otherwise(_repeated_long(words, keys))


def _repeated_long(words: Column, keys: Column) -> Column:
    window = lambda h, i: F.struct(h.alias("h"), *[F.get(words, i + d).alias(f"w{d}") for d in range(3)], i.alias("i"))
    order = F.array_sort(F.transform(keys, window))  # hashes first, so words are compared where they may be equal

    def same(a: Column, b: Column) -> Column:
        out = a["h"] == b["h"]
        for d in range(3):
            out = out & (a[f"w{d}"] == b[f"w{d}"])
        return F.coalesce(out, F.lit(False))

    def covered(s: Column) -> Column:
        hits = F.filter(s, lambda x, j: same(x, F.get(s, j - 1)) | same(x, F.get(s, j + 1)))
        return F.size(F.array_distinct(F.flatten(F.transform(hits, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    return F.get(F.transform(F.array(order), covered), 0)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each row.

    Words and windows are variables of lambdas, which are worked out once a row; as columns, a filter
    pushed below them could copy their expressions into the lambdas that read them."""
    own = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    words = F.filter(F.split("text", f"{SPACES}+"), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(F.translate(x, "\t\x0b\x0c\r", "    "))) > 0)
    once = lambda value, f: F.get(F.transform(F.array(value), f), 0)
    of_words = once(words, lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), once(windows(w), lambda k: repeated(w, k)).alias("repeated")))
    made = own.select("doc_id", "text", of_words.alias("of"), once(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).alias("dup"))
    return made.select(
        "doc_id",
        F.col("of.n").cast("long").alias("n_words"),
        F.col("of.chars").cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.col("dup").cast("long").alias("n_dup_lines"),
        F.col("of.repeated").cast("long").alias("n_repeat_words"),
    )


#: What rules may ask about: expressions over the statistics.
FEATURES = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "repeated_share": "n_repeat_words / greatest(n_words, 1)",
    "duplicate_lines": "cast(n_dup_lines AS double)",
    "duplicate_lines_per_100_words": "100 * n_dup_lines / greatest(n_words, 1)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "words": "cast(n_words AS double)",
}
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    value: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] > self.value if self.above else row[self.feature] <= self.value

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>' if self.above else '<='} {self.value!r}D"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def covers(self, row: dict) -> bool:
        return all(c.holds(row) for c in self.conditions)

    def sql(self) -> str:
        return " AND ".join(c.sql() for c in self.conditions)


def _value(rule: Rule, rows: list[tuple[dict, bool]]) -> float:
    hit = [bad for x, bad in rows if rule.covers(x)]
    return (2 * sum(hit) - len(hit)) / len(hit) if hit else -1.0


def grow(rows: list[tuple[dict, bool]], s: Settings) -> Rule | None:
    """Adds the condition with the largest gain until none helps."""
    chosen: list[Condition] = []
    while len(chosen) < s.most_conditions:
        p, n = sum(bad for _, bad in rows), sum(not bad for _, bad in rows)
        if not p or not n:
            break
        best, found = 0.0, None
        for f in FEATURES:
            values = sorted((x[f], bad) for x, bad in rows)
            keys, hits, total = [v for v, _ in values], [0], len(values)
            for _, bad in values:
                hits.append(hits[-1] + bad)
            for i in range(1, s.thresholds):
                t = keys[min(total - 1, i * total // s.thresholds)]
                at = bisect_left(keys, t)
                while at < total and keys[at] <= t:
                    at += 1
                if at < total:
                    t = (t + keys[at]) / 2  # with a margin on both sides
                for above, k, q in ((True, total - at, hits[-1] - hits[at]), (False, at, hits[at])):
                    if q and k < total:
                        gain = q * (log2(q / k) - log2(p / (p + n)))
                        if gain > best + 1e-9:
                            best, found = gain, Condition(f, above, float(t))
        if not found:
            break
        chosen.append(found)
        rows = [(x, bad) for x, bad in rows if found.holds(x)]
    return Rule(tuple(chosen)) if chosen else None


def prune(rule: Rule, rows: list[tuple[dict, bool]]) -> Rule:
    """The shortest beginning of the rule with the best value on rows it didn't grow on."""
    return max((Rule(rule.conditions[:k]) for k in range(1, len(rule.conditions) + 1)), key=lambda r: (_value(r, rows), -len(r.conditions)))


def cover(rows: list[tuple[dict, bool]], settings: Settings | None = None) -> list[Rule]:
    """An ordered list of rules for the rows marked True."""
    s, rules = settings or Settings(), []
    while len(rules) < s.most_rules:
        rule = grow([r for i, r in enumerate(rows) if i % 3], s)
        if rule is None:
            break
        rule = prune(rule, rows[::3])
        hit = [bad for x, bad in rows if rule.covers(x)]
        if len(hit) < s.least_rows or (sum(hit) + 1) / (len(hit) + 2) < s.least_precision:
            break
        rules.append(rule)
        rows = [(x, bad) for x, bad in rows if not rule.covers(x)]
    return rules


def learn(docs: DataFrame, labels: DataFrame, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> list[Rule]:
    """From ``labels`` (``id_col``, ``label``: 1 good, 0 bad); rows that fail the base rule teach nothing."""
    s = settings or Settings()
    some = labels.select(F.col(id_col).alias("doc_id"), F.col(label).cast("int").alias("good")).na.drop().orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.most_rows)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(some.select("doc_id").distinct()), "doc_id", "left_semi")  # of most_rows ids
    stats = statistics(own).join(F.broadcast(some), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * s.most_rows)
    got = stats.selectExpr("good", f"{BASE_FAILED} AS failed", *[f"{e} AS {n}" for n, e in FEATURES.items()]).collect()
    return cover([({f: float(r[f]) for f in FEATURES}, r["good"] == 0) for r in got if not r["failed"]], s)


def verdict(rules: list[Rule]) -> Column:
    """False for rows of the first rule that covers them, in order; true for others."""
    out = None
    for r in rules:
        out = F.when(F.expr(r.sql()), False) if out is None else out.when(F.expr(r.sql()), False)
    return F.lit(True) if out is None else out.otherwise(True)


def judge(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics of each row, base_failed and kept."""
    base = F.expr(BASE_FAILED)
    return statistics(docs, id_col, text_col).withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & verdict(rules))
