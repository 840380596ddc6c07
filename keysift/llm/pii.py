"""Personal data by fixed rules and by bootstrapped contextual extraction, in DataFrame functions only.

One scan matches the rules and cuts out candidate tokens (those with a digit), all with the words before
them; everything after it works on those few rows.  Seed entities, whole rule matches and machine-made
identifiers, stand in lexical contexts; contexts and the values met in them form a graph on which
confidence is passed to and fro.  Contexts that rank high give away identifiers of forms not seen before.

Positions are code points.  A match's place follows from the lengths of the texts between matches,
which splitting by the same pattern gives, added up over the document's matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keysift.llm.tables import text_only, written

# Kinds in the order in which they are listed; the last is the method's own.
KINDS = ["email", "ip", "card", "phone", "id"]

# What the rules match.  A run that fails from its first character fails from every later one, so
# matching may start only where a run or the last match's end does, and runs are never given back; this
# keeps long runs linear and changes no match.
LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": (rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    "card": (r"[0-9]++(?:[\x20-][0-9]++)*+", r"[0-9][0-9\x20-]{5}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
}
# A token with a digit, and the words before it.
TOKEN = r"(?<!\S)[^\s0-9]*+[0-9]\S*+"
BEFORE = r"((?:\S+\s+){1,2})$"
LABELLED = r"^([A-Za-z_.-]+[=:])"
OPENING = r"^((?:[A-Za-z_.-]+[=:])?[\"'(\[<]*)"
# The same before a rule's match, which need not start a token: what opens it, its label, and the words without a digit before it.
OPENED = r"[\"'(\[<]+$"
MATCH_LABEL = r"(?<!\S)([A-Za-z_.-]+[=:])$"
MATCH_BEFORE = r"((?:(?<!\S)[^\s0-9]+\s+){1,2})$"
CLOSING = r"(?<![^\p{L}\p{N}])[^\p{L}\p{N}]++$"

# Machine-made identifiers that are seeds beside the rules' matches: hexadecimal strings and capitals with digits.
SEEDS = r"^(?=.*[0-9])(?:(?=.*[a-f])[0-9a-f]{16,64}|(?=.*[A-Z])[A-Z0-9]{16,40})$"

ROUNDS = 3
# Least confidence of a context, least distinct seeds met in it, and shortest value that it gives away.
CONFIDENCE = 0.8
SUPPORT = 5
SHORTEST = 6
# Values that a context's confidence starts with, all of them counting as none.
DOUBT = 1.0


def _found(pattern: str, trigger: str) -> Column:
    """Matches in the column ``text`` and the lengths and ends of the texts between them; null where the trigger is absent."""
    gaps = F.transform(F.split("text", pattern, -1), lambda g: F.struct(F.length(g).alias("n"), F.right(g, F.lit(64)).alias("tail")))
    both = F.struct(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("hits"), gaps.alias("gaps"))
    return F.when(F.col("text").rlike(trigger), both)


def _candidates() -> Column:
    tails = F.transform(
        F.split("text", TOKEN, -1), lambda g: F.struct(F.length(g).alias("n"), F.regexp_extract(F.right(g, F.lit(64)), BEFORE, 1).alias("before"))
    )
    both = F.struct(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)).alias("hits"), tails.alias("gaps"))
    return F.when(F.col("text").rlike("[0-9]"), both)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check sum in which every second digit from the right counts double."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c: F.ascii(c) - 48)
    weighed = F.transform(values, lambda d, i: F.when(i % 2 == 0, d).when(d < 5, 2 * d).otherwise(2 * d - 9))
    return F.aggregate(weighed, F.lit(0), lambda total, d: total + d) % 10 == 0


def _holds(kind: Column, match: Column) -> Column:
    digits = _digits(match)
    parts = F.transform(F.split(match, r"\."), lambda part: F.regexp_replace(part, "^0+(?=.)", ""))
    small = F.forall(parts, lambda part: (F.length(part) <= 3) & (F.lpad(part, 3, "0") <= "255"))
    card = F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    phone = F.length(digits).between(9, 15)
    return F.when(kind == "ip", small).when(kind == "card", card).when(kind == "phone", phone).otherwise(True)


def _scanned(docs: DataFrame, *keep: str) -> DataFrame:
    """One scan of all texts: a row number, the columns named, and the raw matches; texts themselves are not kept."""
    columns = [_found(*PATTERNS[kind]).alias(kind) for kind in KINDS[:-1]]
    return docs.select(F.monotonically_increasing_id().alias("row"), *keep, *columns, _candidates().alias("token"))


def _placed(scanned: DataFrame, column: str, *extra: Column) -> DataFrame:
    """``row``, ``start``, ``end`` and ``hit`` of the matches in one column."""
    hits = scanned.where(F.size(F.col(f"{column}.hits")) > 0).select("row", F.posexplode(F.arrays_zip(f"{column}.hits", f"{column}.gaps")).alias("i", "m"))
    hits = hits.where("m.hits is not null").select("row", "i", F.col("m.hits").alias("hit"), F.col("m.gaps.n").alias("gap"), *extra)
    upto = Window.partitionBy("row").orderBy("i")
    end = F.sum(F.col("gap") + F.length("hit")).over(upto).cast("long")
    return hits.withColumn("end", end).withColumn("start", F.col("end") - F.length("hit"))


def _words(before: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(before), r"\s+", " ")), "[0-9]+", "0")


def _rule_spans(scanned: DataFrame) -> DataFrame:
    """Spans of the fixed rules: ``row``, ``kind``, ``start``, ``end``, ``context`` and ``instance`` of the whole match."""
    spans = None
    for kind in KINDS[:-1]:
        own = _placed(scanned, kind, F.col("m.gaps.tail").alias("tail")).select("row", F.lit(kind).alias("kind"), "start", "end", "hit", "tail")
        spans = own if spans is None else spans.union(own)
    spans = spans.where(_holds(F.col("kind"), F.col("hit"))).withColumn("tail", F.regexp_replace("tail", OPENED, ""))
    label = F.regexp_extract("tail", MATCH_LABEL, 1)
    context = F.when(label != "", F.lower(label)).otherwise(_words(F.regexp_extract("tail", MATCH_BEFORE, 1)))
    return spans.select("row", "kind", "start", "end", context.alias("context"), F.md5("hit").alias("instance"))


def _tokens(scanned: DataFrame, rules: DataFrame) -> DataFrame:
    """Values with their place and ``context``: one for each rule's span, and the candidates that meet none; and whether they are seeds."""
    tokens = _placed(scanned, "token", F.col("m.gaps.before").alias("before"))
    opening = F.regexp_extract("hit", OPENING, 1)
    rest = F.substr("hit", F.length("opening") + 1, F.length("hit"))
    label = F.regexp_extract("hit", LABELLED, 1)
    tokens = tokens.withColumn("opening", opening).withColumn("value", F.regexp_replace(rest, CLOSING, ""))
    tokens = tokens.withColumn("context", F.when(label != "", F.lower(label)).otherwise(_words(F.col("before"))))
    start = F.col("start") + F.length("opening")
    instance, size, seed = F.md5("value").alias("instance"), F.length("value").alias("size"), F.col("value").rlike(SEEDS).alias("seed")
    tokens = tokens.select("row", start.alias("start"), (start + F.length("value")).alias("end"), "context", instance, size, seed)

    # A span meets one before it if the farthest end so far is beyond its start, and one after it if that starts before its end.
    seeds = rules.select("row", "start", "end", "context", "instance", (F.col("end") - F.col("start")).cast("int").alias("size"), F.lit(True).alias("seed"))
    both = tokens.withColumn("rule", F.lit(False)).unionByName(seeds.withColumn("rule", F.lit(True)))
    order = Window.partitionBy("row").orderBy("start")
    farthest = F.max(F.when(F.col("rule"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    nearest = F.min(F.when(F.col("rule"), F.col("start"))).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    both = both.withColumn("meets", F.coalesce(farthest > F.col("start"), F.lit(False)) | F.coalesce(nearest < F.col("end"), F.lit(False)))
    return both.where("rule or (not meets and size > 0)").drop("meets")


def score_contexts(tokens: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``context``, ``confidence`` and ``support`` (distinct seeds) after ``rounds`` of passing confidence over the graph.

    A context is as sure as its values are on average, a value as sure as one of its contexts being right;
    seeds are certain.  Edges count once however often a pair occurs.
    """
    seed = F.max(F.col("seed").cast("double"))
    edges = written(tokens.where("context != ''").groupBy("context", "instance").agg(seed.alias("seed")), "context-edges")
    values = edges.select("context", "instance", "seed", F.col("seed").alias("sure"))
    scores = None
    for turn in range(rounds):
        scores = values.groupBy("context").agg((F.sum("sure") / (F.count("*") + DOUBT)).alias("confidence"), F.sum("seed").cast("long").alias("support"))
        if turn + 1 < rounds:
            met = edges.join(scores.select("context", "confidence"), "context")
            doubt = F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999999)))))
            sure = met.groupBy("instance").agg(F.greatest(F.max("seed"), 1 - doubt).alias("sure"))
            values = written(edges.join(sure, "instance").select("context", "instance", "seed", "sure"), "context-values")
    return scores


def _method_spans(tokens: DataFrame) -> DataFrame:
    """Spans of seeds that no rule met, and of values in contexts of high confidence."""
    scores = score_contexts(tokens)
    strong = scores.where((F.col("confidence") >= CONFIDENCE) & (F.col("support") >= SUPPORT)).select("context", F.lit(True).alias("strong"))
    found = tokens.where("not rule").join(strong, "context", "left")
    return found.where(F.col("seed") | (F.col("strong") & (F.col("size") >= SHORTEST))).select("row", F.lit("id").alias("kind"), "start", "end")


def _all_spans(scanned: DataFrame) -> DataFrame:
    rules = written(_rule_spans(scanned), "rule-spans")
    tokens = written(_tokens(scanned, rules), "tokens")
    return rules.select("row", "kind", "start", "end").union(_method_spans(tokens))


def _of_kind(kind: str) -> Column:
    return F.filter("spans", lambda s: s.kind == kind)


def _listed(kinds: list[str]) -> Column:
    own = F.filter("spans", lambda s: s.rank < len(kinds))
    return F.concat_ws(",", F.transform(own, lambda s: F.concat_ws(":", s.kind, s.start, s.end)))


def personal_data(docs: DataFrame) -> DataFrame:
    """Personal data of every document.

    One row per document: ``doc_id``; ``n_email``, ``n_ip``, ``n_card``, ``n_phone`` and ``n_id``; ``base_sha256``
    of the rules' spans and ``spans``, all of them, as kind:start:end (code points, end exclusive) by kind and
    start, joined by commas.

    Null and empty texts have no spans.  Matches of different kinds may overlap; the method's own spans
    overlap no rule's.  Repeated rows give repeated results and, as the graph's edges, count once.
    Other columns are not read.
    """
    scanned = written(_scanned(text_only(docs), "doc_id"), "pii-scan")
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")) - 1
    spans = _all_spans(scanned).select("row", F.struct(rank.cast("int").alias("rank"), "start", "end", "kind").alias("span"))
    by_row = spans.groupBy("row").agg(F.sort_array(F.collect_list("span")).alias("spans"))
    counts = [F.size(_of_kind(kind)).cast("long").alias(f"n_{kind}") for kind in KINDS]
    with_all = scanned.select("row", "doc_id").join(by_row, "row", "left")
    with_all = with_all.withColumn("spans", F.coalesce("spans", F.expr("cast(array() as array<struct<rank:int,start:bigint,end:bigint,kind:string>>)")))
    return with_all.select("doc_id", *counts, F.sha2(_listed(KINDS[:-1]), 256).alias("base_sha256"), _listed(KINDS).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``personal_data`` replaced by its kind in angle brackets.

    Overlapping spans become one, named after the first.  All columns stay; null texts stay null.
    """
    # Rows alike in id and text have the same spans, so they are joined by both.
    scanned = written(_scanned(text_only(docs).withColumn("digest", F.sha2("text", 256)), "doc_id", "digest"), "pii-scan")
    order = Window.partitionBy("row").orderBy("start", "end", "kind")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = _all_spans(scanned).withColumn("new", F.coalesce(F.col("start") >= reached, F.lit(True)).cast("int"))
    spans = spans.withColumn("island", F.sum("new").over(order))
    spans = spans.groupBy("row", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "end", "kind")).alias("kind"))
    by_row = spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("spans"))
    by_text = scanned.select("row", "doc_id", "digest").join(by_row, "row").dropDuplicates(["doc_id", "digest"])
    by_text = by_text.select(F.col("doc_id").alias("same_id"), F.col("digest").alias("same_digest"), "spans")

    text = F.col("row.text").cast("string")
    rows = docs.select(F.struct("*").alias("row")).withColumn("digest", F.sha2(F.coalesce(text, F.lit("")), 256))
    bounds = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda s: s.end))
    pieces = F.transform(
        "spans",
        lambda s, i: F.concat(F.substr(text, F.get(bounds, i).cast("int") + 1, (s.start - F.get(bounds, i)).cast("int")), F.lit("<"), F.upper(s.kind), F.lit(">")),
    )
    tail = F.substr(text, F.element_at(bounds, -1).cast("int") + 1, F.length(text))
    clean = F.when(F.col("spans").isNotNull(), F.concat(F.array_join(pieces, ""), tail)).otherwise(text)
    same = F.col("row.doc_id").cast("long").eqNullSafe(F.col("same_id")) & (F.col("digest") == F.col("same_digest"))
    return rows.join(by_text, same, "left").select(F.col("row").withField("text", clean).alias("row")).select("row.*")
