"""Quality rules as weak supervision: rules vote or abstain, EM estimates how far each is to be trusted.

Every rule votes that a document is good, votes that it is bad, or abstains where it can't tell; an abstention is no
evidence. Votes are counted by pattern over all documents (at most 3 ** len(RULES) rows, however large the corpus).
Expectation-maximisation over those counts fits a latent class for good documents and one for each kind of defect,
since the rules that see one kind of defect know nothing of another: the classes' shares, and per class and rule how
likely a vote is one for bad, which is the rule's accuracy there. Each class starts from what its rules are meant for,
good documents from how often a rule accuses any (one that accuses most can't be right), and each stays anchored to it by PRIOR_VOTES votes, so that it keeps its meaning. A document is kept if its posterior of
being good reaches the threshold and it passes the base rule: a vote of a rule that is often wrong is outweighed by
others, votes of rules that prove reliable are not. All of it is DataFrame operations; EM is one expression over one row.

Defined results: null or empty text has no words and fails the base rule; repeated rows each keep their row; a null
doc_id stays null; an empty table gives no rows; extra columns of the input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import WORD_GAP, let, stored, words

WINDOW = 8

#: Rule -> conditions over the measures under which it votes that the document is bad, and good; otherwise it abstains.
RULES: dict[str, tuple[str, str]] = {
    "symbols": ("n_symbols * 10 > n_words", "n_symbols * 50 <= n_words"),
    "bars": ("n_bars * 5 > n_words", "n_bars * 50 <= n_words"),
    "shouting": ("n_shouts * 10 > n_words", "n_shouts * 50 <= n_words"),
    "case": ("n_upper * 100 > 30 * word_chars", "n_upper * 1000 >= 5 * word_chars AND n_upper * 100 <= 6 * word_chars"),
    "dup_lines": ("n_dup_lines * 4 > n_lines", "n_dup_lines = 0 AND n_lines >= 4"),
    "repeats": ("n_repeat_words * 5 > n_words", "n_repeat_words = 0 AND n_words >= 50"),
    "variety": ("n_words >= 50 AND n_distinct * n_distinct < 4 * n_words", "n_words >= 50 AND n_distinct * n_distinct >= 12 * n_words"),
    "ends": ("n_words >= 20 AND (n_ends * 50 < n_words OR n_ends * 5 > 2 * n_words)", "n_ends * 25 >= n_words AND n_ends * 5 <= n_words"),
    "word_length": ("word_chars * 2 > 13 * n_words OR word_chars * 10 < 35 * n_words", "word_chars * 10 >= 43 * n_words AND word_chars * 10 <= 58 * n_words"),
}
#: Kind of defect -> the rules meant for it.
DEFECTS: dict[str, tuple[str, ...]] = {
    "noise": ("symbols", "word_length"),
    "tables": ("symbols", "bars"),
    "shouting": ("shouting", "case", "ends"),
    "repetition": ("dup_lines", "repeats", "variety", "ends"),
}
ABSTAIN, GOOD, BAD = 0, 1, 2
ITERATIONS = 40
#: What EM starts from: the share of good documents, and how likely a vote is one for bad in a good document (at least),
#: of a rule meant for the document's defect, and of another rule (at least). Each start weighs as many votes as PRIOR_VOTES.
PRIOR_GOOD, FALSE_ALARM, CAUGHT, ASIDE, PRIOR_VOTES = 0.85, 0.02, 0.7, 0.04, 4.0


def repeated_words(wordlist: Column, window: int = WINDOW) -> Column:
    """Words inside windows of ``window`` words that stand twice or more in the text, the first one included."""

    def of_hashes(h: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            n = F.size(s)
            same = F.transform(s, lambda x, k: F.when(((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k < n - 1) & (F.get(s, k + 1)["h"] == x["h"])), x["i"]))
            start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
            step = lambda acc, p: F.struct((acc["n"] + p + window - F.greatest(p, acc["end"])).alias("n"), (p + window).alias("end"))
            return F.aggregate(F.sort_array(F.array_compact(same)), start, step, lambda acc: acc["n"])

        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, of_sorted))

    def of_words(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)]))
        return F.when(F.size(w) <= window, F.lit(0)).otherwise(let(hashes, of_hashes))

    return let(F.transform(wordlist, lambda x: F.xxhash64(x)), of_words)


def _left(text: Column, pattern: str) -> Column:
    """How many characters of the text the pattern removes."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def measures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(F.col("t"), "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"))
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    of_words = let(words(F.col("t")), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct"), repeated_words(w).alias("repeat")))
    return rows.select(
        "doc_id",
        of_words.alias("w"),
        of_lines.alias("l"),
        F.length(F.regexp_replace("t", WORD_GAP, "")).alias("word_chars"),
        _left(F.col("t"), "[#*$%&|<>]+").alias("n_symbols"),
        _left(F.col("t"), "\\p{Lu}+").alias("n_upper"),
        _left(F.col("t"), "!+").alias("n_shouts"),
        _left(F.col("t"), "\\|+").alias("n_bars"),
        _left(F.col("t"), "[.!?。！？…؟।]+").alias("n_ends"),
    ).select(
        "doc_id",
        *[c.cast("long").alias(n) for n, c in (("n_words", F.col("w.n")), ("word_chars", F.col("word_chars")), ("n_symbols", F.col("n_symbols")), ("n_dup_lines", F.col("l.dup")), ("n_repeat_words", F.col("w.repeat")), ("n_lines", F.col("l.n")), ("n_upper", F.col("n_upper")), ("n_shouts", F.col("n_shouts")), ("n_bars", F.col("n_bars")), ("n_ends", F.col("n_ends")), ("n_distinct", F.col("w.distinct")))],
    )


def votes() -> Column:
    """One entry a rule: BAD, GOOD or ABSTAIN."""
    return F.array(*[F.when(F.expr(bad), BAD).when(F.expr(good), GOOD).otherwise(ABSTAIN) for bad, good in RULES.values()])


def estimate(patterns: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """(votes, n) -> one row: prior (share of each class, good documents first) and bad (per class and rule, how likely
    a vote is one for bad)."""
    n_classes = 1 + len(DEFECTS)
    rules, classes = F.sequence(F.lit(0), F.lit(len(RULES) - 1)), F.sequence(F.lit(0), F.lit(n_classes - 1))
    anchor = F.col("anchor")

    def accused(r: int) -> Column:
        """What good documents get of a rule's votes at the start, if no more documents are bad than the prior says."""
        count = lambda *kinds: F.aggregate("patterns", F.lit(0.0), lambda acc, p: acc + F.when(p["votes"][r].isin(*kinds), p["n"]).otherwise(0.0))
        return F.greatest(F.lit(FALSE_ALARM), F.least(F.lit(1 - FALSE_ALARM), (count(BAD) / F.greatest(count(BAD, GOOD), F.lit(1.0)) - (1 - PRIOR_GOOD)) / PRIOR_GOOD))

    def of_good(good: Column) -> Column:
        return F.array(good, *[F.array(*[F.greatest(F.lit(CAUGHT if rule in own else ASIDE), good[r]) for r, rule in enumerate(RULES)]) for own in DEFECTS.values()])

    def posterior(state: Column, p: Column) -> Column:
        def of_class(k: Column) -> Column:
            def evidence(acc: Column, r: Column) -> Column:
                vote, b = F.get(p["votes"], r), F.get(F.get(state["bad"], k), r)
                return acc + F.when(vote == BAD, F.log(b)).when(vote == GOOD, F.log(1 - b)).otherwise(0.0)

            return F.aggregate(rules, F.log(F.get(state["prior"], k)), evidence)

        def normed(e: Column) -> Column:
            return let(F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x), lambda t: F.transform(e, lambda x: x / t))

        return let(F.transform(classes, of_class), lambda o: let(F.array_max(o), lambda top: let(F.transform(o, lambda x: F.exp(x - top)), normed)))

    def step(state: Column, _: Column) -> Column:
        def update(e: Column) -> Column:
            total = lambda w: F.aggregate(e, F.lit(0.0), lambda acc, p: acc + p["n"] * w(p))
            share = lambda k: total(lambda p: F.get(p["post"], k))
            cast = lambda k, r, *kinds: total(lambda p: F.when(F.get(p["votes"], r).isin(*kinds), F.get(p["post"], k)).otherwise(0.0))
            rate = lambda k, r: (cast(k, r, BAD) + PRIOR_VOTES * F.get(F.get(anchor, k), r)) / (cast(k, r, BAD, GOOD) + PRIOR_VOTES)
            return F.struct(
                F.transform(classes, lambda k: (share(k) + 1) / (total(lambda p: F.lit(1.0)) + n_classes)).alias("prior"),
                F.transform(classes, lambda k: F.transform(rules, lambda r: rate(k, r))).alias("bad"),
            )

        e_step = F.transform(F.col("patterns"), lambda p: F.struct(p["votes"].alias("votes"), p["n"].alias("n"), posterior(state, p).alias("post")))
        return let(e_step, update)

    prior = F.array(F.lit(PRIOR_GOOD), *[F.lit((1 - PRIOR_GOOD) / len(DEFECTS))] * len(DEFECTS))
    one_row = patterns.agg(F.sort_array(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n")))).alias("patterns"))
    one_row = one_row.withColumn("anchor", let(F.array(*map(accused, range(len(RULES)))), of_good))
    start = F.struct(prior.alias("prior"), anchor.alias("bad"))
    return one_row.select(F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), start, step).alias("m")).select("m.*")


def p_good(prior: list[float], bad: list[list[float]], vote: str = "votes") -> Column:
    """Posterior of being good, by an estimated model."""
    odds = []
    for share, rates in zip(prior, bad, strict=True):
        own = F.lit(math.log(share / prior[0]))
        for r, (b, g) in enumerate(zip(rates, bad[0], strict=True)):
            own = own + F.when(F.get(vote, F.lit(r)) == BAD, math.log(b / g)).when(F.get(vote, F.lit(r)) == GOOD, math.log((1 - b) / (1 - g))).otherwise(0.0)
        odds.append(F.exp(F.least(own, F.lit(700.0))))
    return F.lit(1.0) / sum(odds[1:], odds[0])


def quality_rules(docs: DataFrame, *, threshold: float = 0.5, iterations: int = ITERATIONS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, p_good, votes."""
    found = stored(measures(docs, id_col=id_col, text_col=text_col).withColumn("votes", votes()), "measures")
    # (1 + len(DEFECTS)) * (1 + len(RULES)) numbers reach the driver, whatever the input
    model = estimate(found.groupBy("votes").agg(F.count("*").alias("n")), iterations).first()
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    good = p_good(model["prior"], model["bad"])
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (good >= threshold)).alias("kept"), good.alias("p_good"), "votes")
