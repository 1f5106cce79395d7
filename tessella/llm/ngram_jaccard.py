"""Exact Jaccard self-join of documents on distinct word 3-grams, by token-combination prefixes.

Copies of one word sequence form a class, and only one member of each takes part. Shingles are ordered by how many
classes hold them, rarest first, so those of a single class, which can't be shared, fill most of a prefix.
Two similar sets share a shingle within their prefixes, and two within prefixes longer by one. A rare shingle is
indexed alone. Frequent ones are indexed as pairs of a set's extended prefix, so that a passage common to many
documents joins only those whose prefixes consist of such passages; a set with too many frequent shingles in its
prefix for all pairs of them meets the others on single ones instead. The smaller of two sets is indexed by its
shorter prefix and the larger probes. Candidates are then verified on whole sets, which travel once to each block
of partners rather than once to each partner. All of it is DataFrame operations.

Up to the candidates a shingle goes by a token of TOKEN_BITS bits, so that its postings take less room. Shingles of one
document that clash stay as many equal tokens of it: two documents then share at least as many tokens as shingles,
and their n-th equal tokens stand in one common order, so what is said of prefixes holds and no pair is lost.

Of 256 tokens COUNTED are counted and come first in the order, by their counts. The others come after them by their
bits, and only those travel that a set needs to fill its longest prefix; they are treated as frequent, so that nothing
rare stands behind what is frequent. That is one order for all sets, so what is said of prefixes holds.

A class is known by the digest of its word sequence, never by a doc_id, so what else stands under an id of one of its
rows doesn't matter. Postings of shingles that more documents hold than a task should count are counted by a partial
aggregation and a join that AQE splits; which ones these are is read from a histogram of fixed size over the postings of
about SAMPLED classes. The sample only says how a shingle is counted; each count is over all postings.

Defined results: null, empty and all-space texts have an empty set, are linked with nothing and are their own
component; every row is a document of its own, so repeated rows count each other and several texts under one doc_id
are each linked by their own words (a component's id is the smallest doc_id of its rows); a row without doc_id is
returned, linked with nothing, its component null; an empty table gives no rows; extra columns of the input are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.llm.common import discard, let, lower_ascii, small_side, stored, words

SHINGLE = 3
#: A shingle in more classes is frequent. It only divides the work; links are the same for any value.
FREQUENT = 64
#: Sets with up to so many frequent shingles in the prefix are indexed by pairs of them.
COMBINED = 8
#: Buckets of the histogram of postings, and the share of a task's postings from which on a bucket is counted apart.
BUCKETS, HOT_SHARE = 1 << 16, 0.5
#: Classes whose postings the histogram holds; all of them if there are no more.
SAMPLED = 20_000
#: Bits of a token. It only divides the work; links are the same for any value.
TOKEN_BITS = 40
#: Of 256 tokens so many are counted and come first. It only divides the work; links are the same for any value.
COUNTED = 128
#: Where tokens that aren't counted stand in the order: behind any count.
BEHIND = 1 << 40
#: Partners in one list that travels beside a set.
PARTNERS = 4096
#: Candidate pairs of one neighbourhood that are verified in one block.
NEIGHBOURS = 1 << 16


def shingles(wordlist: Column) -> Column:
    """64-bit hashes of the distinct 3-word shingles; of the whole sequence if it's shorter; none without words."""

    def of(w: Column) -> Column:
        n = F.size(w)
        long = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)]))
        return F.when(n >= SHINGLE, F.array_distinct(long)).when(n > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))

    return let(wordlist, of)


def _sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, key (digest of the word sequence), s (the set)."""
    w = words(lower_ascii(F.col(text_col)))
    return docs.select(F.col(id_col).alias("id"), let(w, lambda x: F.struct(F.unhex(F.md5(F.array_join(x, " "))).alias("key"), shingles(x).alias("s"))).alias("x")).select("id", "x.key", "x.s")


def _token(h: Column) -> Column:
    return h.bitwiseAND(F.lit((1 << TOKEN_BITS) - 1))


def _is_counted(h: Column) -> Column:
    """h is a shingle or its token."""
    return h.bitwiseAND(F.lit(min(255, (1 << TOKEN_BITS) - 1))) < COUNTED


def _needed(n: Column) -> Column:
    """How many tokens the longest prefix of a set has, longer by one."""
    return F.least(n, _prefix(n, 1, False) + 1)


def _size(s: Column) -> Column:
    """n, and how many tokens of the set are sent (m_sent)."""
    n = F.size(s)
    return F.struct(n.alias("n"), F.greatest(F.size(F.filter(s, _is_counted)), _needed(n)).cast("int").alias("m_sent"))


def _sent(s: Column) -> Column:
    """The shingles that are counted, and where they don't fill the longest prefix the first tokens of the others."""

    def of(whole: Column) -> Column:
        def filled(counted: Column) -> Column:
            lack = (_needed(F.size(whole)) - F.size(counted)).cast("int")
            others = F.array_sort(F.transform(F.filter(whole, lambda h: ~_is_counted(h)), _token))
            return F.when(lack <= 0, counted).otherwise(F.concat(counted, F.slice(others, 1, F.greatest(lack, F.lit(0)))))

        return let(F.filter(whole, _is_counted), filled)

    return let(s, of)


def _postings(sets: DataFrame) -> DataFrame:
    """(id, h), h the token of a shingle that is sent. An outer explode, since Spark would filter the rows of an inner
    one by the size of ``s`` before all joins, and so split each text twice, those of rows left out as well."""
    return sets.select("id", F.explode_outer(_sent(F.col("s"))).alias("h")).where("h is not null").select("id", _token(F.col("h")).alias("h"))


def _prefix(n: Column, shared: int, index: bool) -> Column:
    """Length of the prefix in which ``shared`` common shingles must stand, against sets at least as large or any."""
    need = F.floor((n * 14 + 16) / 17) if index else F.floor((n * 7 + 9) / 10)
    return n - need + shared


def _candidates(prefixes: DataFrame) -> DataFrame:
    """Pairs (x, y), x the smaller set, that share a signature; each once. A stored table."""
    columns = ["id", "n", "pos", "index"]
    rare = prefixes.where((F.col("cnt") <= FREQUENT) & (F.col("pos") <= F.col("probe1"))).withColumn("index", F.col("pos") <= F.col("index1")).withColumn("sig", F.col("h"))

    frequent = prefixes.where((F.col("cnt") > FREQUENT) & (F.col("pos") <= F.col("probe1") + 1))
    per_set = Window.partitionBy("id")
    # before: the frequent shingle before it in the set. Where two sets share that too, their pair is met there.
    frequent = stored(frequent.withColumn("f", F.count("*").over(per_set)).withColumn("before", F.lag("h").over(per_set.orderBy("pos"))), "frequent")
    # Sets of one shingle have no pairs; larger similar ones always share two.
    by_pairs = (F.col("f") <= COMBINED) & (F.col("n") > 1)
    few, many = frequent.where(by_pairs), frequent.where(~by_pairs)
    # Pairs of frequent shingles: at most COMBINED rows are gathered for a set.
    gathered = few.groupBy("id", "n", "index1").agg(F.sort_array(F.collect_list(F.struct("pos", "h"))).alias("t"))
    later = lambda a: F.filter(F.col("t"), lambda b: b["pos"] > a["pos"])
    pairs = F.flatten(F.transform("t", lambda a: F.transform(later(a), lambda b: F.struct(F.xxhash64(a["h"], b["h"]).alias("sig"), a["pos"].alias("pos"), (b["pos"] <= F.col("index1") + 1).alias("index")))))
    combined = gathered.select("id", "n", F.explode(pairs).alias("p")).select("id", "n", "p.pos", "p.index", "p.sig")
    single = lambda x: x.where(F.col("pos") <= F.col("probe1")).select("id", "n", "pos", (F.col("pos") <= F.col("index1")).alias("index"), F.col("h").alias("sig"), "before")

    # The work of a signature grows with the square of its sets, so partitions that are small in bytes aren't merged.
    tasks = 2 * int(prefixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = lambda x: x.repartition(tasks, "sig")

    def meet(small: DataFrame, large: DataFrame) -> DataFrame:
        sent = [c for c in (*columns[:3], "before") if c in small.columns and c in large.columns]
        a, b = small.where("index").select("sig", *[F.col(c).alias("x_" + c) for c in sent]), large.select("sig", *[F.col(c).alias("y_" + c) for c in sent])
        left = F.least(F.col("x_n") - F.col("x_pos"), F.col("y_n") - F.col("y_pos")) + 1  # if this is the first shingle shared
        fits = (F.struct("x_n", "x_id") < F.struct("y_n", "y_id")) & (F.col("x_n") * 10 >= F.col("y_n") * 7) & (left * 17 >= (F.col("x_n") + F.col("y_n")) * 7)
        if "before" in sent:  # both stand further ahead there, so it fits there as well; distinct has less to do
            fits = fits & F.coalesce(F.col("x_before") != F.col("y_before"), F.lit(True))
        return a.join(b, "sig").where(fits).select(F.col("x_id").alias("x"), F.col("y_id").alias("y"))

    found = meet(rare, rare).unionByName(meet(spread(combined), spread(combined))).unionByName(meet(spread(single(many)), spread(single(frequent)))).unionByName(meet(spread(single(few)), spread(single(many))))
    pairs = stored(found.distinct(), "pairs")
    discard(frequent)
    return pairs


def _homes(pairs: DataFrame, blocks: int) -> DataFrame:
    """x, lead, block: where the set of x meets its partners, and the set that both are compared with. Sets whose
    smallest partner (or self) is the same, as in a group of near copies, have that as their lead and go to one block, so
    that a partner of many of them travels there once; a neighbourhood of more than NEIGHBOURS pairs is spread by x over
    several. A stored table."""
    sided = pairs.select(F.col("x").alias("id"), F.col("y").alias("other"), F.lit(1).alias("own")).unionByName(pairs.select(F.col("y").alias("id"), F.col("x").alias("other"), F.lit(0).alias("own")))
    lead = sided.groupBy("id").agg(F.min("other").alias("least"), F.sum("own").alias("own")).where("own > 0").select(F.col("id").alias("x"), F.least("id", "least").alias("lead"), "own")
    slots = F.ceil(F.sum("own").over(Window.partitionBy("lead")) / NEIGHBOURS)
    return stored(lead.select("x", "lead", F.pmod(F.xxhash64("lead", F.pmod(F.xxhash64("x"), slots)), F.lit(blocks)).alias("block")), "homes")


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The candidate pairs that are similar. pairs and sets (id, s) are stored tables. A set is sent once to each block
    and lead of its partners, in lists of about PARTNERS.

    There it becomes what it lacks of the lead's set and what it has beside it. For any lead, x and y share
    |x| - |more x| - |less y| + |less x & less y| + |more x & more y| shingles. Near copies differ from their lead in few,
    so their many pairs are decided by these sizes, or by short intersections, and not by whole sets."""
    spark = pairs.sparkSession
    blocks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Both sides are hashed by block; without this setting they would be shuffled by (block, x) once more, set by pair.
    # It is one of a session of its own, so that no other plan gets it.
    side = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if side.conf.isModifiable(key):
            side.conf.set(key, value)
    side.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    own = lambda t: side.read.schema(t.schema).parquet(t._stored_at)
    homes_stored = _homes(pairs, blocks)
    pairs, sets, homes = own(pairs), own(sets), own(homes_stored)

    placed = stored(pairs.join(small_side(homes), "x"), "placed")
    lists = F.ceil(F.col("count") / PARTNERS).cast("int")
    many = stored(placed.groupBy("y", "block", "lead").count().select("y", "block", "lead", lists.alias("lists")).where("lists > 1"), "many")
    listed = placed if many.isEmpty() else placed.join(small_side(many), ["y", "block", "lead"], "left")
    part = F.lit(0) if many.isEmpty() else F.pmod(F.hash("x"), F.coalesce("lists", F.lit(1)))
    grouped = listed.groupBy("y", "block", "lead", part.alias("part")).agg(F.collect_list("x").alias("xs"))
    leads = homes.select("block", "lead").distinct().join(sets.select(F.col("id").alias("lead"), F.col("s").alias("of_lead")), "lead").repartition(blocks, "block")

    def against(side: DataFrame, name: str, *keep: str) -> DataFrame:
        parts = [F.size("s").alias(f"{name}_n"), F.array_except("of_lead", "s").alias(f"{name}_less"), F.array_except("s", "of_lead").alias(f"{name}_more")]
        return side.repartition(blocks, "block").join(leads.hint("shuffle_hash"), ["block", "lead"]).select("block", name, *keep, *parts)

    ys = against(grouped.join(sets.select(F.col("id").alias("y"), "s"), "y"), "y", "xs")
    xs = against(sets.select(F.col("id").alias("x"), "s").join(small_side(homes), "x"), "x")
    joined = ys.withColumn("x", F.explode("xs")).drop("xs").join(xs.hint("shuffle_hash"), ["block", "x"])
    size, both_n = F.size, F.col("x_n") + F.col("y_n")
    least = F.col("x_n") - size("x_more") - size("y_less")
    most = least + F.least(size("x_less"), size("y_less")) + F.least(size("x_more"), size("y_more"))
    both = least + size(F.array_intersect("x_less", "y_less")) + size(F.array_intersect("x_more", "y_more"))
    enough = lambda n: n * 170 >= both_n * 70  # noqa: E731  (n / (x_n + y_n - n) >= 0.7)
    similar = F.when(enough(least), True).when(~enough(most), False).otherwise(enough(both))
    links = stored(joined.where(similar).select("x", "y"), "links")
    discard(homes_stored, placed, many)
    return spark.read.schema(links.schema).parquet(links._stored_at)


def components(links: DataFrame) -> DataFrame:
    """id, component: the smallest id reachable, for every id in the links (x, y). Smallest label of the neighbours,
    then the label of the label, until nothing changes; labels only fall, so this ends, however long a chain is."""
    both = stored(links.select("x", "y").unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    labels = stored(both.groupBy(F.col("x").alias("id")).agg(F.least(F.min("y"), F.first("x")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("y"), F.col("component").alias("c")), "y").groupBy(F.col("x").alias("id")).agg(F.min("c").alias("c"))
        lower = stored(labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "c").alias("c")), "lower")
        jump = lower.select(F.col("id").alias("c"), F.col("c").alias("further"))
        further = stored(lower.join(jump, "c", "left").select("id", "old", F.least("c", F.coalesce("further", "c")).alias("component")), "labels")
        discard(labels, lower)
        labels = further
        if labels.where(F.col("old") != F.col("component")).isEmpty():
            discard(both)
            return labels.select("id", "component")


def _counted(postings: DataFrame, sample: DataFrame, rate: int, hot_share: float) -> DataFrame:
    """(id, h) with cnt, how many postings h has, where that is over 1. A window counts what fits a task. Where one
    bucket of the histogram holds ``hot_share`` of a task's postings or more, its shingles are counted by partial sums.
    sample: the postings of about one in ``rate`` classes."""
    tasks = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucket = F.pmod("h", F.lit(BUCKETS))
    sizes = sample.groupBy(bucket.alias("bucket")).count()
    sizes = stored(sizes, "histogram")  # at most BUCKETS rows
    least = (sizes.agg(F.sum("count")).first()[0] or 0) / tasks * hot_share
    # at most tasks / hot_share rows reach the driver, as no more buckets can be so large
    hot = [r["bucket"] for r in sizes.where(F.col("count") >= max(least, 2 / rate)).select("bucket").collect()]
    discard(sizes)
    # What isn't counted stays, as the place of the tokens after it depends on it.
    ordered = lambda p: p.where((F.col("cnt") > 1) | ~_is_counted(F.col("h"))).select("id", "h", F.when(_is_counted(F.col("h")), F.col("cnt")).otherwise(BEHIND).alias("cnt"))
    window = lambda p: ordered(p.withColumn("cnt", F.count("*").over(Window.partitionBy("h"))))
    if not hot:
        return window(postings)
    apart = stored(postings.where(bucket.isin(hot)), "hot")
    counts = apart.groupBy("h").agg(F.count("*").alias("cnt")).where((F.col("cnt") > 1) | ~_is_counted(F.col("h")))
    return window(postings.where(~bucket.isin(hot))).unionByName(ordered(apart.join(counts, "h")))


def similar_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", hot_share: float = HOT_SHARE) -> DataFrame:
    """doc_id, n_shingles, n_similar, component_id; a row for each input row."""
    listed = stored(_sets(docs, id_col, text_col).select("id", "key", let(F.col("s"), _size).alias("z")).select("id", "key", "z.*"), "listed")
    live = listed.where((F.col("n") > 0) & F.col("id").isNotNull())
    classes = stored(live.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("m_sent").alias("m_sent")), "classes")
    # A class goes by a short hash of its key, or by the key itself should two keys share a hash.
    short = classes.groupBy(F.xxhash64("key")).count().where("count > 1").isEmpty()
    cid = F.xxhash64("key") if short else F.col("key")

    # One row stands for each class. Rows are left out by id before their texts are split; only where an id has
    # several texts, or a row is repeated, something is left for later.
    reps = classes.select(F.col("rep").alias("id"), "key")
    idle = stored(listed.where("id is not null").select("id").distinct().join(reps.select("id"), "id", "left_anti"), "idle")
    standing = live.join(reps.select("id").distinct(), "id", "left_semi")
    strangers = stored(standing.join(reps, ["id", "key"], "left_anti").select("id", "key").distinct(), "strangers")
    repeated = stored(live.join(reps, ["id", "key"]).groupBy("id", "key").count().where("count > 1").select("id", "key"), "repeated")
    has_strangers, has_repeated = not strangers.isEmpty(), not repeated.isEmpty()

    def one_each(rows: DataFrame) -> DataFrame:
        """id (that of the class), s."""
        # Empty sets stay: they have no postings and meet no pair, and a filter on sizes would split each text twice.
        sets = _sets(rows, id_col, text_col)
        if has_strangers:
            sets = sets.join(small_side(strangers), ["id", "key"], "left_anti")
        if has_repeated:
            again = small_side(repeated)
            sets = sets.join(again, ["id", "key"], "left_anti").unionByName(sets.join(again, ["id", "key"], "left_semi").dropDuplicates(["id", "key"]))
        return sets.select(cid.alias("id"), "s")

    rows = docs.select(id_col, text_col).where(F.col(id_col).isNotNull())
    some = rows.join(small_side(idle).withColumnRenamed("id", id_col), id_col, "left_anti")
    # The two large shuffles carry ids, hashes and counts alone; sizes come after them.
    rate = max(1, round(classes.count() / SAMPLED))
    sample = some.where(F.pmod(F.xxhash64(id_col), F.lit(rate)) == 0)
    shared = _counted(_postings(one_each(some)), _postings(one_each(sample)), rate, hot_share)
    per_set = Window.partitionBy("id")
    n = F.col("n")
    ranked = shared.withColumn("m", F.count("*").over(per_set)).withColumn("r", F.row_number().over(per_set.orderBy("cnt", "h")))
    sizes = classes.select(cid.alias("id"), "n", "m_sent")
    # ranked is hashed and sorted by id already, so only the sizes travel here
    placed = ranked.join(sizes, "id").withColumn("pos", F.col("m_sent") - F.col("m") + F.col("r")).drop("m_sent", "m", "r")
    placed = placed.withColumn("probe1", _prefix(n, 1, False)).withColumn("index1", _prefix(n, 1, True))
    prefixes = stored(placed.where("pos <= probe1 + 1"), "prefixes")
    discard(idle)

    pairs = _candidates(prefixes)
    discard(prefixes)
    # Sets are made again only of candidates: rows are filtered by id before their texts are split.
    ids = pairs.select(F.col("x").alias("id")).unionByName(pairs.select(F.col("y").alias("id"))).distinct()
    met = stored(classes.select(cid.alias("id"), "rep").join(ids, "id", "left_semi").select("rep").distinct(), "met")
    sets = stored(one_each(rows.join(small_side(met), F.col(id_col) == F.col("rep"), "left_semi")), "sets")
    discard(met)
    links = _verify(pairs, sets)
    discard(pairs, sets)

    counts = classes.select(cid.alias("id"), "key", "rep", "copies")
    sided = links.select(F.col("x").alias("id"), F.col("y").alias("other")).unionByName(links.select(F.col("y").alias("id"), F.col("x").alias("other")))
    linked = sided.join(counts.select(F.col("id").alias("other"), "copies"), "other").groupBy("id").agg(F.sum("copies").alias("linked"))
    of_class = counts.join(linked, "id", "left").join(components(links), "id", "left").withColumn("component", F.coalesce("component", "id"))
    of_class = stored(of_class.select("key", "rep", "component", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_similar")), "linked")
    smallest = of_class.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_key = of_class.join(smallest, "component").select("key", "n_similar", "component_id")
    row = listed.withColumn("key", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("key")))
    return row.join(by_key, "key", "left").select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.coalesce("n_similar", F.lit(0)).cast("long").alias("n_similar"), F.coalesce("component_id", "id").alias("component_id"))


ORACLE = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words
), tokens AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS h FROM sets
), meets AS (
  SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS common FROM tokens a JOIN tokens b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM meets WHERE common * 100 >= (nx + ny - common) * 70
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, (SELECT count(*) FROM links l WHERE l.x = s.doc_id)::BIGINT AS n_similar, (SELECT min(r.y) FROM reach r WHERE r.x = s.doc_id) AS component_id FROM sets s
"""
