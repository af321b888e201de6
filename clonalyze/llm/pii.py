"""Personal data by weak-supervision aggregation, in DataFrame and SQL functions only.

Base spans (email, ip, card, phone) come from fixed patterns and stay. Wider patterns give
candidates; labelers (strict format, check digits and value ranges, gazetteers of cue words
and issuers, left context, boundaries) vote for, against, or abstain. Expectation-maximisation
over the counts of vote patterns estimates how reliable each labeler is, without labels;
the posterior of every candidate then trains the final span classifier, a naive Bayes model
over span features, which decides on the candidates beyond the base spans.

A text is scanned inside its row: matches and the gaps between them, from which positions
follow. Only spans with a few characters of context leave the row. The tables that
expectation-maximisation reads have a row per combination of votes, whatever the input.

The patterns are written so that they run in time linear in the text: a match can begin
only where the previous one ended or where a run of its first class begins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clonalyze.llm.common import staged

CONTEXT = 40        # characters of context on each side of a span
ROUNDS = 12         # of expectation-maximisation
PRIOR_ROWS = 20     # candidates' worth of the expected reliabilities beside the data

#: By labeler and vote: P(vote | personal), P(vote | not) that it is expected to have.
EXPECTED = {
    "v_format": {1: (0.9, 0.6), 0: (0.08, 0.2), -1: (0.02, 0.2)},
    "v_check": {1: (0.9, 0.6), 0: (0.08, 0.2), -1: (0.02, 0.2)},
    "v_gazetteer": {1: (0.6, 0.2), 0: (0.38, 0.6), -1: (0.02, 0.2)},
    "v_context": {1: (0.5, 0.05), 0: (0.48, 0.45), -1: (0.02, 0.5)},
    "v_boundary": {1: (0.95, 0.7), 0: (0.0, 0.0), -1: (0.05, 0.3)},
}

# ---- fixed values: patterns and gazetteers ----------------------------------------

#: Patterns of the base kinds.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: Wider patterns, one alternative per kind of candidate.
WIDER = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\[at\]|\(at\))\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\[dot\]|\(dot\)|\.)\x20?[A-Za-z0-9-]{1,63}+){1,8}+",
    "phone": r"(?<![0-9A-Za-z+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "secret": r"(?<![0-9A-Za-z])AKIA[0-9A-Z]{16}(?![0-9A-Za-z])|(?<![0-9A-Za-z])(?i:password|passwd|token|api_key|secret)\x20?[=:]\x20?\x22?[0-9A-Za-z]{12,}+\x22?",
}

#: Cue words by kind, in the four languages of the tables.
CUES = {
    "email": ["email", "e-mail", "mail", "contact", "correo", "courriel", "adresse", "write"],
    "ip": ["ip", "host", "server", "address", "login", "serveur", "servidor"],
    "card": ["card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta"],
    "phone": ["call", "phone", "tel", "telefon", "telephone", "mobile", "fax", "handy", "llame"],
    "ssn": ["ssn", "social", "security", "sozialversicherung"],
    "iban": ["iban", "account", "konto", "bank", "cuenta", "compte"],
    "secret": ["password", "passwd", "token", "api_key", "secret", "key"],
}

#: Words before a number that speak against personal data.
AGAINST = ["version", "section", "page", "figure", "table", "chapter", "isbn", "article", "no", "nr", "v"]
# ---- end of fixed values -------------------------------------------------------------

KINDS = ["email", "ip", "card", "phone", "ssn", "iban", "secret"]
VOTES = ["v_format", "v_check", "v_gazetteer", "v_context", "v_boundary"]
FEATURES = ["kind", "origin", "digits", "separators", "v_check", "v_gazetteer", "v_context", "v_boundary"]


def _matches(text: Column, pattern: str, possible: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.when(possible, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)


def _gaps(text: Column, pattern: str, found: Column) -> Column:
    """The text between the matches, split once."""
    return F.when(F.size(found) > 0, F.split(text, pattern, -1))


def _pieces(gaps: Column, found: Column, kind: str, origin: str) -> Column:
    """Matches in order with the length of the gap before and the context on both sides."""
    return F.when(F.size(found) > 0, F.transform(found, lambda m, i: F.struct(
        F.lit(kind).alias("kind"), F.lit(origin).alias("origin"), (i + 1).alias("nth"), m.alias("span"),
        F.length(F.get(gaps, i)).alias("gap"),
        F.right(F.get(gaps, i), F.lit(CONTEXT)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(CONTEXT)).alias("after"))))


def _scanned(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rid, id, pieces): one row per text; pieces are the matches of all patterns."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    src = df.select(F.col(f"`{id_col}`").alias("id"), text.alias("t"))
    has = src.withColumn("digit", F.col("t").rlike("[0-9]"))
    t, digit = F.col("t"), F.col("digit")
    at_sign = F.contains(t, F.lit("@"))
    possible = {"email": at_sign, "ip": digit, "card": digit, "phone": digit & F.contains(t, F.lit("+"))}
    # beyond the base kinds a text needs a digit, or an "at" in brackets
    wide = digit | F.contains(t, F.lit("at]")) | F.contains(t, F.lit("at)"))
    cols = [_matches(t, BASE[k], possible[k]).alias(f"m_{k}") for k in BASE]
    cols += [_matches(t, WIDER[k], wide).alias(f"w_{k}") for k in WIDER]
    every_match = [f"m_{k}" for k in BASE] + [f"w_{k}" for k in WIDER]
    found = has.select("id", "t", *cols)
    gapped = found.select("id", *every_match, *[_gaps(t, BASE[k], F.col(f"m_{k}")).alias(f"g_m_{k}") for k in BASE],
                          *[_gaps(t, WIDER[k], F.col(f"w_{k}")).alias(f"g_w_{k}") for k in WIDER])
    parts = [_pieces(F.col(f"g_m_{k}"), F.col(f"m_{k}"), k, "base") for k in BASE]
    parts += [_pieces(F.col(f"g_w_{k}"), F.col(f"w_{k}"), k, "wider") for k in WIDER]
    kind = "array<struct<kind:string,origin:string,nth:int,span:string,gap:int,before:string,after:string>>"
    every = F.flatten(F.array(*[F.coalesce(p.cast(kind), F.array().cast(kind)) for p in parts]))
    return gapped.select(F.monotonically_increasing_id().alias("rid"), "id", every.alias("pieces"))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""),
                       lambda c, i: F.when(i % 2 == 1, F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int") + 1))
                       .otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _octets_ok(span: Column) -> Column:
    part = F.transform(F.split(span, r"\."), lambda p: F.ltrim(p, F.lit("0")))
    return F.forall(part, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))


def _spans(scanned: DataFrame) -> DataFrame:
    """One row per match that its own checks don't drop, with code point positions."""
    each = scanned.select("rid", F.explode("pieces").alias("p")).select("rid", "p.*")
    w = Window.partitionBy("rid", "kind", "origin").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("end", (F.sum(F.col("gap") + F.length("span")).over(w)).cast("long"))
    each = each.withColumn("start", F.col("end") - F.length("span"))
    each = each.withColumn("d", F.when(F.col("kind").isin("card", "phone"), _digits(F.col("span"))).otherwise(F.lit("")))
    n = F.length("d")
    base_ok = (F.when(F.col("kind") == "ip", _octets_ok(F.col("span")))
               .when(F.col("kind") == "card", n.between(16, 19) & F.when(n.between(16, 19), _luhn(F.col("d"))).otherwise(False))
               .when(F.col("kind") == "phone", n.between(8, 15)).otherwise(True))
    return each.filter((F.col("origin") == "wider") | base_ok).drop("nth", "gap", "d")


def _apart(spans: DataFrame) -> DataFrame:
    """Base spans, and wider ones that overlap no base span of their text."""
    is_base = F.col("origin") == "base"
    keys = ["start", "end", "kind", "origin"]
    earlier = Window.partitionBy("rid").rowsBetween(Window.unboundedPreceding, -1)
    before = F.max(F.when(is_base, F.col("end"))).over(earlier.orderBy(*keys))
    # what follows is running, too, in the opposite order
    after = F.min(F.when(is_base, F.col("start"))).over(earlier.orderBy(*[F.col(k).desc() for k in keys]))
    marked = spans.withColumn("_b", before).withColumn("_a", after)
    clear = F.coalesce(F.col("_b") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("_a") >= F.col("end"), F.lit(True))
    return marked.filter(is_base | clear).drop("_b", "_a")


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0).cast("int")


def _labelled(spans: DataFrame) -> DataFrame:
    """Votes of the labelers (1 for, -1 against, 0 abstain) and the classifier's features."""
    kind, span = F.col("kind"), F.col("span")
    before, after = F.lower(F.col("before")), F.col("after")
    digits = _digits(span)
    n = F.length(digits)
    words = F.split(F.regexp_replace(before, r"[^\p{L}\p{N}_-]+", " "), " ")
    cues = F.create_map(*[x for k in KINDS for x in (F.lit(k), F.array(*[F.lit(c) for c in CUES[k]]))])
    cue = F.arrays_overlap(words, F.element_at(cues, kind))
    against = F.exists(F.slice(F.reverse(F.filter(words, lambda x: x != "")), 1, 1), lambda x: x.isin(AGAINST))
    luhn = F.when(kind == "card", _luhn(digits)).otherwise(F.lit(None))
    plain = F.regexp_replace(F.regexp_replace(span, r"\x20?(\[at\]|\(at\))\x20?", "@"), r"\x20?(\[dot\]|\(dot\))\x20?", ".")
    strict = (F.when(kind == "email", plain.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{2,24}$"))
              .when(kind == "ip", span.rlike(r"^([0-9]{1,3}\.){3}[0-9]{1,3}$"))
              .when(kind == "card", span.rlike(r"^([0-9]{16,19}|([0-9]{4}[ -]){3}[0-9]{4,7})$"))
              .when(kind == "phone", span.rlike(r"^(\+[0-9]{1,3}[ .-]?)?\(?[0-9]{2,4}\)?([ .-]?[0-9]{2,4}){2,4}$"))
              .when(kind == "iban", F.length(F.regexp_replace(span, " ", "")).between(15, 34) & (n >= 8))
              .when(kind == "secret", (n >= 2) & span.rlike("[A-Za-z]")).otherwise(True))
    # values that can't be of their kind
    area = F.substring(digits, 1, 3)
    check = (F.when(kind == "card", luhn)
             .when(kind == "ip", ~span.rlike(r"^(0|127|255)\."))
             .when(kind == "ssn", ~(area.isin("000", "666") | (area >= "900")) & (F.substring(digits, 4, 2) != "00") & (F.substring(digits, 6, 4) != "0000"))
             .when(kind == "phone", ~digits.rlike(r"^(.)\1+$") & n.between(8, 15)))
    gazetteer = (F.when(kind == "card", digits.rlike("^(4|5[1-5]|2[2-7]|3[47]|6)"))
                 .when(kind == "email", F.lower(span).rlike(r"(\.|dot[\])]\x20?)(com|org|net|edu|gov|io|info|de|fr|es|uk|eu)$"))
                 .when(kind == "secret", span.startswith("AKIA"))
                 .when(kind == "iban", F.substring(span, 1, 2).isin("DE", "FR", "ES", "GB", "IT", "NL", "AT", "BE", "CH", "PT", "PL", "IE", "LU")))
    left_ok = (F.col("before") == "") | ~F.col("before").rlike(r"[\p{L}\p{N}]$")
    right_ok = (after == "") | ~after.rlike(r"^[\p{L}\p{N}]")
    return spans.select(
        "*",
        _vote(strict, ~strict).alias("v_format"), _vote(check, ~check).alias("v_check"),
        _vote(gazetteer, F.lit(False)).alias("v_gazetteer"), _vote(cue & ~against, against).alias("v_context"),
        _vote(left_ok & right_ok, ~(left_ok & right_ok)).alias("v_boundary"),
        F.least(n, F.lit(20)).cast("string").alias("digits"),
        F.substring(F.array_join(F.array_sort(F.array_distinct(F.split(F.regexp_replace(span, r"[\p{L}\p{N}]", ""), ""))), ""), 1, 4).alias("separators"))


def _reliabilities(patterns: DataFrame, rounds: int) -> tuple[float, dict[str, dict[int, tuple[float, float]]]]:
    """Prior, and P(vote | personal), P(vote | not) by labeler and vote, by expectation-maximisation.

    ``patterns`` counts candidates by their votes: a row per combination. A round is one
    aggregation of it to a single row. It starts from ``EXPECTED``, which says which of the two classes is the
    personal one; a constant ``PRIOR_ROWS`` of it keep rare votes from certainty, and fade as the data grow.
    """
    prior, p = 0.5, EXPECTED
    for _ in range(rounds):
        q = posterior(prior, p)
        weighted = patterns.withColumn("q", q)
        sums = [F.sum(F.col("n") * F.col("q")).alias("yes"), F.sum("n").alias("all")]
        for v in VOTES:
            for x in (1, 0, -1):
                hit = F.when(F.col(v) == x, F.col("n")).otherwise(0)
                sums += [F.sum(hit * F.col("q")).alias(f"{v}_{x}_y"), F.sum(hit).alias(f"{v}_{x}_a")]
        r = weighted.agg(*sums).first()
        if not r["all"]:
            break
        yes, no = r["yes"], r["all"] - r["yes"]
        own = PRIOR_ROWS
        prior = (yes + own) / (yes + no + 2 * own)
        p = {v: {x: ((r[f"{v}_{x}_y"] + own * EXPECTED[v][x][0]) / (yes + own), (r[f"{v}_{x}_a"] - r[f"{v}_{x}_y"] + own * EXPECTED[v][x][1]) / (no + own))
                 for x in (1, 0, -1)} for v in VOTES}
    return prior, p


def posterior(prior: float, p: dict[str, dict[int, tuple[float, float]]]) -> Column:
    """P(personal | votes) as an expression over the vote columns."""
    logit = F.lit(math.log(prior / (1 - prior)))
    for v in VOTES:
        for x in (1, -1):
            yes, no = p[v][x]
            logit = logit + F.when(F.col(v) == x, F.lit(math.log(yes / no))).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-logit))


def _classified(labelled: DataFrame, combos: DataFrame, prior: float, p: dict) -> DataFrame:
    """Naive Bayes over span features, trained on the posteriors: adds ``p_personal``."""
    scored = combos.withColumn("q", posterior(prior, p))
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).cast("string").alias("x")) for f in FEATURES])).alias("fx")
    by_value = scored.select(pairs, "n", "q").groupBy("fx.f", "fx.x").agg(
        F.sum(F.col("n") * F.col("q")).alias("yes"), F.sum(F.col("n") * (1 - F.col("q"))).alias("no"))
    total = scored.agg(F.sum(F.col("n") * F.col("q")).alias("yes"), F.sum(F.col("n") * (1 - F.col("q"))).alias("no")).first()
    yes, no = (total["yes"] or 0.0) + 1, (total["no"] or 0.0) + 1
    weight = F.log((F.col("yes") + 0.5) / F.lit(yes)) - F.log((F.col("no") + 0.5) / F.lit(no))
    table = by_value.select(F.col("f"), F.col("x"), weight.alias("w"))
    # a row per combination of features gets its score once; spans look it up
    keyed = scored.withColumn("c", F.xxhash64(*[F.col(f).cast("string") for f in FEATURES]))
    sums = (keyed.select("c", *FEATURES).distinct().select("c", pairs).select("c", "fx.*").join(table, ["f", "x"])
            .groupBy("c").agg(F.sum("w").alias("s")))
    sums = staged(sums.select("c", (1 / (1 + F.exp(-(F.col("s") + math.log(yes / no))))).alias("p_personal")), "pii-classifier")
    return labelled.withColumn("c", F.xxhash64(*[F.col(f).cast("string") for f in FEATURES])).join(sums, "c", "left").drop("c")


def find_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", at_least: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): one row per text with its ``rid``; its spans with kind, start, end, origin, p_personal.

    Base spans always stay; others need ``p_personal`` >= ``at_least``. Positions count code
    points, ends are exclusive.
    """
    scanned = staged(_scanned(df, id_col, text_col), "pii-scanned")
    labelled = staged(_labelled(_apart(_spans(scanned))), "pii-labelled")
    combos = staged(labelled.groupBy(*VOTES, *[f for f in FEATURES if f not in VOTES]).agg(F.count(F.lit(1)).alias("n")), "pii-combinations")
    patterns = staged(combos.groupBy(*VOTES).agg(F.sum("n").alias("n")).coalesce(1), "pii-patterns")
    prior, p = _reliabilities(patterns, ROUNDS)
    found = _classified(labelled, combos, prior, p)
    kept = found.filter((F.col("origin") == "base") | (F.col("p_personal") >= at_least))
    return scanned.select("rid", "id"), kept.select("rid", "kind", "start", "end", "origin", "span", "p_personal")


def annotate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", at_least: float = 0.5) -> DataFrame:
    """One row per row of ``df``: the identifier, counts and spans.

    ``n_email``, ``n_ip``, ``n_card``, ``n_phone`` and ``base`` (kind:start:end, comma-joined)
    are of the base spans; ``spans`` holds all. Null text counts as empty; null and repeated
    identifiers are kept apart row by row. An empty table gives an empty result.
    """
    texts, spans = find_spans(df, id_col, text_col, at_least)
    rank = F.element_at(F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))]), F.col("kind"))
    item = F.struct(rank.alias("k"), F.col("start").alias("s"), F.col("end").alias("e"), F.col("kind").alias("kind"), (F.col("origin") == "base").alias("base"))
    # a text's own spans, bounded by its length
    by_text = spans.groupBy("rid").agg(F.array_sort(F.collect_list(item)).alias("all"))
    joined = texts.join(by_text, "rid", "left")
    every = F.coalesce(F.col("all"), F.array().cast("array<struct<k:int,s:bigint,e:bigint,kind:string,base:boolean>>"))

    def told(items: Column) -> Column:
        return F.array_join(F.transform(items, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")

    base = F.filter(every, lambda x: x["base"])

    def number(kind: str) -> Column:
        return F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return joined.select(F.col("id").alias(id_col), *[number(k) for k in BASE], told(base).alias("base"), told(every).alias("spans"))
