"""Personal data by bootstrapped contextual extraction (native: DataFrame functions only).

Four kinds are found by form alone (``BASE``): email, ip, card, phone.  These mentions are the seeds.
Every seed and every other token that looks like an identifier stands in a context: the two words before
it, or the word before and the word after.  A lexical pattern is such a context; an instance is the text
of a mention.  Patterns and instances form a graph of distinct pairs, which is scored in rounds:

* confidence of a pattern for a kind: ``S / (S + C + (F - S) / 4)``, where ``F`` of its distinct instances
  fit the kind's form, ``S`` is the sum of their scores and ``C`` the number of the others: what is
  contrary counts whole, what is open a quarter; it counts only with a support ``S`` of ``SUPPORT`` or more;
* score of an instance for a kind: 1 for a seed; else, if its form fits the kind loosely, one minus the
  product of ``1 - confidence`` over its patterns of at least ``CONFIDENCE``, which lets it support
  further patterns in the next round.

Tokens in the context of a pattern of at least ``CONFIDENCE`` whose form fits become spans of its kind.

A pattern can only reach the support if it has that many distinct instances, so edges of patterns with
fewer are dropped before the first round; this loses no pattern.  Texts are read once; what is shuffled
are mentions with their contexts, never texts.  Pairs are made distinct by partial aggregation before
they meet scores.

Spans are in code points, end exclusive.  Base matches are leftmost and do not overlap within a kind; a
match that fails its check (an ip part above 255, digits or Luhn sum of a card, digits of a phone) is
dropped and not tried again.  A discovered span overlaps no base span.  Counts and ``base`` cover base
matches alone; ``spans`` holds all.

Defined cases: null and empty texts have no spans; rows are judged one by one, so null or repeated ids
cannot mix; equal texts count once as instances; contexts that run past the text's start or end, or
past ``WINDOW`` code points, hold fewer words; ties between kinds go to the higher confidence, then to
the kind listed first; an empty table has no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import narrow, staged

KINDS = ("email", "ip", "card", "phone")
# Runs are matched possessively, and an email begins where its run begins (or where the last match
# ended): what is found is the same, in time that grows with the text alone.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_SPACE = r"\x20\x09-\x0D"
# A token with a digit or @, and the groups of digits that follow it, one space apart.
CANDIDATE = (rf"(?<![^{_SPACE}])[^{_SPACE}0-9@]*+[0-9@][^{_SPACE}]*+"
             rf"(?:\x20[0-9().+-]++(?![^{_SPACE}]))*+")
_BYTE = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|)"
_IP_PARTS = rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$"
# Forms that an unseen identifier of a kind may have.
LOOSE = {
    "email": r"^[^@]+@[^@]+$",
    "ip": r"^[0-9A-Fa-f]*(?:[.:][0-9A-Fa-f]*){3,}(?:[:/][0-9]+)?$",
    "card": r"^[0-9](?:[ -]?[0-9]){11,18}$",
    "phone": r"^[(]?[0-9](?:[ ().-]*[0-9]){6,14}$",
}
# Code points of text on each side in which a context is looked for.
WINDOW = 64
SUPPORT = 3.0
CONFIDENCE = 0.9
ROUNDS = 3
_QUOTES = "[{<\"'“„«"
_ENDS = ".,;:!?)]}>\"'”“»"


def _marks(text: Column, name: str, number: int) -> Column:
    """Matches of one pattern: what lies between two is found by split, the matches beside it.

    Entry ``k`` has the length and both ends of the gap before match ``k``; the last one has no match.
    """
    pattern = BASE.get(name, CANDIDATE)
    needs = text.contains(_NEEDS[name]) if _NEEDS.get(name) else text.rlike("[0-9@]")
    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"),
                        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("s"))
    marks = F.transform(both, lambda x, k: F.struct(
        F.lit(number).alias("kind"), k.alias("k"), F.length(x["gap"]).alias("gap"),
        F.right(x["gap"], F.lit(WINDOW)).alias("left"), F.left(x["gap"], F.lit(WINDOW)).alias("head"),
        x["s"].alias("s")))
    return F.when(needs, marks).otherwise(F.array().cast(
        "array<struct<kind:int,k:int,gap:int,left:string,head:string,s:string>>"))


def _kept(s: Column, kind: Column) -> Column:
    """The check of a match beyond its form."""
    digits = F.regexp_replace(s, "[^0-9]", "")
    return (F.when(kind == KINDS.index("ip"), s.rlike(_IP_PARTS))
            .when(kind == KINDS.index("card"), F.length(digits).between(16, 19) & F.call_function("luhn_check", digits))
            .when(kind == KINDS.index("phone"), F.length(digits).between(8, 15))
            .otherwise(True))


def _words(side: Column) -> Column:
    """Words of a piece of context: lower case, digits as 0, without closing punctuation."""
    return F.regexp_extract_all(F.regexp_replace(F.regexp_replace(F.lower(side), "[0-9]+", "0"),
                                                 rf"[.,;!?]+(?=[{_SPACE}]|$)", ""), F.lit(rf"[^{_SPACE}]+"), F.lit(0))


def mentions(staged_docs: DataFrame) -> DataFrame:
    """``(rid, kind, start, end, s, patterns)``: base mentions, and candidates (kind -1) that meet none.

    Windows run inside one document; both need one exchange by row.
    """
    rows = staged_docs.select("rid", F.explode("marks").alias("m")).select("rid", "m.*").repartition("rid")
    by_kind = Window.partitionBy("rid", "kind").orderBy("k")
    size = F.coalesce(F.length("s"), F.lit(0))
    placed = rows.select("rid", "kind", "s", "left", F.lead("head").over(by_kind).alias("right"),
                         F.sum(F.col("gap") + size).over(by_kind).cast("int").alias("end"))
    base = F.col("kind") >= 0
    bare = F.when(base, F.col("s")).otherwise(F.ltrim("s", F.lit(_QUOTES)))
    trimmed = F.when(base, F.col("s")).otherwise(F.rtrim(F.ltrim("s", F.lit(_QUOTES)), F.lit(_ENDS)))
    placed = placed.where(F.col("s").isNotNull() & _kept(F.col("s"), F.col("kind"))).select(
        "rid", "kind", (F.col("end") - F.length(bare)).alias("start"),
        (F.col("end") - F.length(bare) + F.length(trimmed)).alias("end"), trimmed.alias("s"), "left", "right"
    ).where(F.length("s") > 0)
    up, down = Window.partitionBy("rid").orderBy("start"), Window.partitionBy("rid").orderBy(F.desc("start"))
    meets = placed.withColumn("reach", F.max(F.when(base, F.col("end"))).over(up)).withColumn(
        "next", F.min(F.when(base, F.col("start"))).over(down))
    free = base | ((F.coalesce("reach", F.lit(-1)) <= F.col("start")) &
                   (F.coalesce(F.col("next") >= F.col("end"), F.lit(True))))
    words = meets.where(free).withColumns({"l": _words(F.col("left")), "r": _words(F.col("right"))})
    last, prev, after = (F.get("l", F.size("l") - 1), F.get("l", F.size("l") - 2), F.get("r", F.lit(0)))
    patterns = F.when(last.isNull(), F.array().cast("array<string>")).otherwise(F.array(
        F.concat_ws(" ", F.coalesce(prev, F.lit("^")), last, F.lit("_")),
        F.concat_ws(" ", last, F.lit("_"), F.coalesce(after, F.lit("$")))))
    return words.select("rid", "kind", "start", "end", F.lower("s").alias("s"), patterns.alias("patterns"))


def _fits(s: Column, kind: str) -> Column:
    return s.rlike(LOOSE[kind])


def pattern_graph(found: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Distinct ``(pattern, instance)`` pairs of patterns that could ever count, with seeds and fitting forms."""
    edges = found.select(F.explode("patterns").alias("pattern"), "s", "kind").groupBy("pattern", "s").agg(
        *(F.max((F.col("kind") == k).cast("int")).alias(f"seed_{name}") for k, name in enumerate(KINDS)))
    seeded = F.greatest(*(F.col(f"seed_{k}") for k in KINDS)) == 1
    edges = staged(edges.withColumns({f"fits_{k}": F.when(seeded, F.col(f"seed_{k}") == 1).otherwise(
        _fits(F.col("s"), k)).cast("int") for k in KINDS}), "pattern_edges")
    # a pattern's support is at most the number of its instances of fitting form; its confidence, their share
    able = edges.groupBy("pattern").agg(F.count("*").alias("n"), *(F.sum(f"fits_{k}").alias(k) for k in KINDS)).where(
        F.greatest(*(F.when(F.col(k) >= F.col("n") * confidence, F.col(k)).otherwise(0) for k in KINDS)) >= support)
    return staged(edges.join(able.select("pattern"), "pattern", "left_semi"), "pattern_graph")


def scored_patterns(graph: DataFrame, rounds: int = ROUNDS, support: float = SUPPORT,
                    confidence: float = CONFIDENCE) -> DataFrame:
    """``(pattern, email, ip, card, phone)``: confidences in millionths of the patterns that count, else null.

    Scores are whole millionths, so sums do not depend on the order of rows.
    """
    unit = 1_000_000
    scores = graph.select("s", *(F.lit(0).cast("long").alias(f"x_{k}") for k in KINDS)).where(F.lit(False))
    for turn in range(rounds):
        known = graph.join(scores, "s", "left").withColumns({
            k: F.greatest(F.col(f"seed_{k}") * unit, F.coalesce(f"x_{k}", F.lit(0))) for k in KINDS})
        sums = known.groupBy("pattern").agg(F.count("*").alias("n"), *(F.sum(k).alias(k) for k in KINDS), *(
            F.sum(f"fits_{k}").alias(f"fits_{k}") for k in KINDS))
        conf = {k: F.floor(4 * F.col(k) / (3 * F.col(k) + (4 * F.col("n") - 3 * F.col(f"fits_{k}")) * unit) * unit)
                for k in KINDS}
        strong = staged(sums.select("pattern", *(
            F.when((F.col(k) >= support * unit) & (c >= confidence * unit), c).alias(k) for k, c in conf.items())).where(
            F.coalesce(*KINDS).isNotNull()), "patterns")
        if turn + 1 < rounds:
            missing = {k: F.sum(F.log(1 - F.least(F.col(k) / unit, F.lit(0.999)))) for k in KINDS}
            scores = staged(graph.where(F.greatest(*(F.col(f"seed_{k}") for k in KINDS)) == 0).join(
                strong, "pattern").groupBy("s").agg(*(
                    (F.max(f"fits_{k}") * F.coalesce(F.round((1 - F.exp(m)) * unit), F.lit(0))).cast("long").alias(
                        f"x_{k}") for k, m in missing.items())), "instances")
    return strong


def discovered(found: DataFrame, strong: DataFrame) -> DataFrame:
    """``(rid, kind, start, end)`` of candidates in the context of a pattern that counts and of fitting form."""
    open_ = found.where(F.col("kind") < 0).select("rid", "start", "end", "s", F.explode("patterns").alias("pattern"))
    claims = open_.join(strong, "pattern").select("rid", "start", "end", F.explode(F.array(*(
        F.struct(F.when(_fits(F.col("s"), k), F.col(k)).alias("conf"), F.lit(-n).alias("rank"))
        for n, k in enumerate(KINDS)))).alias("c")).where("c.conf IS NOT NULL")
    best = claims.groupBy("rid", "start", "end").agg(F.max("c").alias("c"))
    return best.select("rid", (-F.col("c.rank")).alias("kind"), "start", "end")


def _listed(spans: Column) -> Column:
    """``kind:start:end`` of spans in order, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(
        ":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS,
                       support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Per row: doc_id, ``n_<kind>`` of base matches, ``base`` and ``spans`` as text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    marks = F.concat(*(_marks(text, k, n) for n, k in enumerate(KINDS)), _marks(text, "candidate", -1))
    read = staged(narrow(docs, id_col, text_col).select(
        F.monotonically_increasing_id().alias("rid"), "doc_id",
        F.filter(marks, lambda m: (m["k"] > 0) | m["s"].isNotNull()).alias("marks")), "marked_texts")
    found = staged(mentions(read), "mentions")
    strong = scored_patterns(pattern_graph(found, support, confidence), rounds, support, confidence)
    base = found.where("kind >= 0").select("rid", "kind", "start", "end")
    both = base.withColumn("seed", F.lit(True)).unionByName(
        discovered(found, strong).withColumn("seed", F.lit(False)))
    span = F.struct("kind", "start", "end")
    listed = both.groupBy("rid").agg(
        F.sort_array(F.collect_list(F.when(F.col("seed"), span))).alias("base"),
        F.sort_array(F.collect_list(span)).alias("spans"),
        *(F.count_if(F.col("seed") & (F.col("kind") == n)).alias(f"n_{k}") for n, k in enumerate(KINDS)))
    out = read.select("rid", "doc_id").join(listed, "rid", "left")
    return out.select("doc_id", *(F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS),
                      *(F.coalesce(_listed(F.col(c)), F.lit("")).alias(c) for c in ("base", "spans")))
