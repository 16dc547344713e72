"""PII by bootstrapped contextual extraction, in DataFrame functions only.

Base entities (email, ip, card, phone) come from fixed patterns with checks.  They, and keys written in hexadecimal
(secrets, which have no base spans and a column of their own), seed a bootstrap.  An occurrence of an identifier has up to
three lexical patterns: the two words before it, the word or delimiter before it and the one after it, both with its shape.
Candidates are what base patterns don't take: addresses that are spelled out ("name (at) site
dot org"), digits in groups with brackets, points, spaces or dashes between, and other tokens with a digit or "@" in them.
A candidate may be of the kinds that it fits: an address has an "@", an "at" or another mark between words, an ip four
groups of digits, a card 13 to 19 digits and a phone 7 to 15 and no letters.  Each one in no base span is an
instance of its own patterns.  Spark scores the graph of patterns and instances round by round: a pattern's confidence
in a kind is the number of its occurrences whose instance is trusted to be of that kind over the number of all its
occurrences; patterns of enough confidence and enough different trusted instances make their other instances
trusted, and these lend weight to further patterns in the next round.  Confident patterns then yield unseen
identifiers, of the kind they are most confident in, in every text.

Base spans are never changed, and what is found beside them never meets them.  Positions are code points, ends exclusive.

Defined results: a null or empty text has no spans; repeated rows get the same spans, and count as
often as they occur; extra spans of a text don't overlap; context words of over 40 characters, or beyond other words, aren't contexts (two words before and
one after are looked for within 84 characters); candidates are of any length, without the
quotes, brackets and marks around them; an empty table gives no rows; other columns are kept only on request,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, materialize

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns, written so that a run of characters is scanned once: a match can only start where
#: such a run starts or where the last match ended (\G), and what follows a repeat can't begin within it.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A kind without base spans, found by context alone, and what seeds it: hexadecimal keys of 32 digits or more.
SECRET = len(KINDS)
NAMES = (*KINDS, "secret")
KEY = "^(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{32,}$"
#: Addresses that are spelled out; with a plain " at " the dots must be spelled too.
AT, DOT = (rf"\x20?(?:\({w}\)|\[{w}\]|\{{{w}\}}|<{w}>)\x20?" for w in ("at", "dot"))
SPELLED = (
    r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9._%+-]++"
    rf"(?:{AT}[A-Za-z0-9-]++(?:(?:{DOT}|\x20dot\x20|\.)[A-Za-z0-9-]++)++|\x20at\x20[A-Za-z0-9-]++(?:(?:{DOT}|\x20dot\x20)[A-Za-z0-9-]++)++)"
)
#: Digits in groups, and tokens with a digit or "@" in them; what may stand around an identifier in one.
CANDIDATE = r"(?<!\S)(?:[\"'`(<\[{]*+[+]?[0-9]++(?:[\x20()\[\]./-]{1,3}[0-9]++)++(?![A-Za-z0-9@])|[^\s0-9@]*+[0-9@]\S*+)"
OPENING, CLOSING = r"^(?!\([0-9]+\))[\"'`(<\[{]+", r"[\"'`)>\]}.,;:!?*$%&#|]+$"
#: What a candidate of each kind looks like.
FITS = {
    "email": r"(?i)^[^\s@]*[a-z][^\s@]*(?:@|[^a-z0-9\s._+-]|\x20?[(\[{<]?\bat\b[)\]}>]?\x20?)[^@]*[a-z]",
    "ip": r"^[0-9]{1,3}(?:[^0-9a-zA-Z]{1,3}[0-9]{1,3}){3}$",
    "card": r"^[0-9](?:[^0-9a-zA-Z]{0,3}[0-9]){12,18}$",
    "phone": r"^[+(\[]{0,2}[0-9](?:[^0-9a-zA-Z]{0,3}[0-9]){6,14}$",
    "secret": r"^[A-Za-z0-9_+/=-]{6,}$",
}
LEAST = 6
ROUNDS, CONFIDENCE, SUPPORT = 3, 0.8, 5
#: Characters beside an entity in which its context is sought; matches or spans that are handled as one block.
BEFORE, BLOCK = 84, 128

SPAN = "array<struct<kind:int,start:bigint,end:bigint>>"


def located(text: Column, pattern: str, probe: Column) -> Column:
    """array<struct<found, gap, before, after>>: leftmost matches without overlap, how many characters lie between
    each and the one before it, the last BEFORE of these (after a 0, which stands for a match before
    them) and the first BEFORE of those that follow (before a 0); probe: a cheap condition without which nothing
    can match."""
    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast("array<struct<found:string,gap:bigint,before:string,after:string>>")
    ends = F.transform(between, lambda b: F.struct(F.length(b).cast("bigint").alias("gap"), F.substring(b, -BEFORE, BEFORE).alias("last"), F.substring(b, 1, BEFORE).alias("first")))
    follow = F.concat(F.slice(ends, 2, F.greatest(F.size(ends) - 1, F.lit(0))), F.array(F.lit(None).cast("struct<gap:bigint,last:string,first:string>")))
    beside = F.arrays_zip(ends.alias("one"), follow.alias("two"))
    pairs = F.zip_with(found, beside, lambda m, b: F.struct(m.alias("found"), b["one"]["gap"].alias("gap"), b["one"]["last"].alias("before"), b["two"]["first"].alias("after")))
    return F.filter(F.when(probe, pairs).otherwise(none), lambda p: p["found"].isNotNull())


def _running(items: Column, value, merge, zero: Column) -> Column:
    """array<struct<item, ahead>>: every item with the values of all items ahead of it merged.  An accumulator that holds
    an array would be copied at every step, so the values are merged in blocks: BLOCK steps an item, and one for each
    pair of blocks."""
    folded = lambda values: F.aggregate(values, zero, merge)

    def cut(all_: Column) -> Column:
        last = F.greatest(F.ceil(F.size(all_) / BLOCK) - 1, F.lit(0)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda j: F.slice(all_, j * BLOCK + 1, F.lit(BLOCK)))

    def based(blocks: Column) -> Column:
        return F.transform(blocks, lambda x, j: F.struct(x["part"].alias("part"), x["values"].alias("values"), folded(F.slice(F.transform(blocks, lambda y: y["all"]), F.lit(1), j)).alias("base")))

    # arrays of one, so that what a lambda uses again and again is made once
    parts = F.flatten(F.transform(F.array(items), cut))
    valued = F.transform(parts, lambda part: F.struct(part.alias("part"), F.transform(part, value).alias("values")))
    summed = F.transform(valued, lambda x: F.struct(x["part"].alias("part"), x["values"].alias("values"), folded(x["values"]).alias("all")))
    bases = F.flatten(F.transform(F.array(summed), based))
    placed = F.transform(bases, lambda x: F.transform(x["part"], lambda item, i: F.struct(item.alias("item"), merge(x["base"], folded(F.slice(x["values"], F.lit(1), i))).alias("ahead"))))
    return F.flatten(placed)


def _positions(pairs: Column) -> Column:
    """Gaps to positions: array<struct<found, at, before, after>>."""
    counted = _running(pairs, lambda p: p["gap"] + F.length(p["found"]), lambda a, b: a + b, F.lit(0).cast("bigint"))

    def one(x: Column, i: Column) -> Column:
        before = x["item"]["before"]
        before = F.when((i == 0) | (F.length(before) == BEFORE), before).otherwise(F.concat(F.lit("0"), before))
        return F.struct(x["item"]["found"].alias("found"), (x["ahead"] + x["item"]["gap"]).alias("at"), before.alias("before"), F.concat(x["item"]["after"], F.lit("0")).alias("after"))

    return F.transform(counted, one)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the checksum of a digit string of 14 to 19 digits holds."""
    even = F.length(digits) % 2
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)), F.lit(0),
        lambda acc, i: acc + F.when((i % 2) == even, F.substring(digits, i, F.lit(1)).cast("int")).otherwise((F.substring(digits, i, F.lit(1)).cast("int") * 2) % 10 + F.floor(F.substring(digits, i, F.lit(1)).cast("int") / 5).cast("int")),
    )
    return (total % 10) == 0


def _valid(kind: str, found: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        parts = F.transform(F.split(found, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return ~F.exists(parts, lambda p: (F.length(p) > 3) | (F.substring(p, 1, 3).cast("int") > 255))
    n = F.length(_digits(found))
    if kind == "card":
        return F.when(n.between(14, 19), _luhn(_digits(found))).otherwise(False)
    return n.between(10, 15)


def entities(text: Column) -> Column:
    """array<struct<start, kind, end, instance, fits, patterns>> of the base entities by start, then kind; kind: place in
    KINDS; instance: hash of its text; fits: a bit for each kind that it may be of; patterns: its lexical patterns."""
    digit = text.rlike("[0-9]")
    probes = {"email": F.contains(text, F.lit("@")), "ip": digit & F.contains(text, F.lit(".")), "card": text.rlike(r"[0-9][\x20-]?[0-9]"), "phone": F.contains(text, F.lit("+")) & digit}

    def of(k: int, kind: str) -> Column:
        good = F.filter(_positions(located(text, PATTERNS[kind], probes[kind])), lambda m: _valid(kind, m["found"]))
        return F.transform(good, lambda m: F.struct(m["at"].alias("start"), F.lit(k).alias("kind"), (m["at"] + F.length(m["found"])).alias("end"), F.xxhash64(m["found"]).alias("instance"), F.lit(1 << k).alias("fits"), _patterns(m["before"], m["found"], m["after"]).alias("patterns")))

    return F.array_sort(F.concat(*(of(k, kind) for k, kind in enumerate(KINDS))))


def _shape(found: Column) -> Column:
    """Letters as a, digits as 0, each run once; other characters as they are."""
    return F.regexp_replace(F.regexp_replace(found, r"\p{L}+", "a"), "[0-9]+", "0")


def _patterns(before: Column, found: Column, after: Column) -> Column:
    """The lexical patterns of an occurrence, lower-cased; contexts that aren't there are left out."""
    shape = F.coalesce(_shape(found), F.lit(""))
    two = F.regexp_replace(F.regexp_extract(before, r"(?:^|\s)([^\s0-9@]{1,40}\s{1,4}[^\s0-9@]{1,40})\s{1,4}[\"'`(<\[{]*$", 1), r"\s+", " ")
    one = F.regexp_extract(before, r"(?:^|\s)([^\s0-9@]{1,40})\s{1,4}[\"'`(<\[{]*$", 1)
    next_ = F.regexp_extract(after, r"^[\"'`)>\]}.,;:!?*$%&#|]*\s{1,4}([^\s0-9@]{1,40})(?:\s|$)", 1)
    made = F.array(F.when(two != "", F.concat(F.lit("two "), two)), F.when(one != "", F.concat(F.lit("one "), one, F.lit(" "), shape)), F.when(next_ != "", F.concat(F.lit("next "), next_, F.lit(" "), shape)))
    return F.transform(F.filter(made, lambda p: p.isNotNull()), F.lower)


def _blocks(spans: Column) -> Column:
    """Spans in blocks with the range that each covers, so that few of many are looked at."""
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / BLOCK).cast("int")), lambda i: F.slice(spans, i * BLOCK + 1, F.lit(BLOCK)))
    made = F.transform(cut, lambda b: F.struct(F.array_min(F.transform(b, lambda s: s["start"])).alias("start"), F.array_max(F.transform(b, lambda s: s["end"])).alias("end"), b.alias("spans")))
    return F.when(F.size(spans) > 0, made).otherwise(F.slice(made, 1, 0))


def _fits(found: Column) -> Column:
    """A bit for each kind whose looks a candidate has."""
    bits = F.lit(0)
    for k, name in enumerate(NAMES):
        bits = bits + F.when(found.rlike(FITS[name]), 1 << k).otherwise(0)
    return bits


def _may_be(fits: str, kind: str) -> Column:
    return F.expr(f"shiftright({fits}, {kind}) & 1 = 1")


def _bracketed(text: Column, word: str) -> Column:
    marks = [F.contains(text, F.lit(a + word + b)) for a, b in ("()", "[]", "{}", "<>")]
    return marks[0] | marks[1] | marks[2] | marks[3]


def spelled(text: Column, taken: str) -> Column:
    """Candidates that are addresses spelled out."""
    dots = F.contains(text, F.lit(" dot ")) | _bracketed(text, "dot")
    return _drawn(text, SPELLED, _bracketed(text, "at") | F.contains(text, F.lit(" at ")) & dots, taken)


def candidates(text: Column, taken: str) -> Column:
    """Candidates that are digits in groups or tokens with a digit or "@"."""
    return _drawn(text, CANDIDATE, text.rlike("[0-9@]"), taken)


def _drawn(text: Column, pattern: str, probe: Column, taken: str) -> Column:
    """array<struct<start, kind, end, instance, fits, patterns>> of the matches of a pattern that meet no taken span (a
    column of _blocks()); kind: SECRET for keys, else -1."""
    tokens = _positions(located(text, pattern, probe))
    bare = F.transform(tokens, lambda m: F.struct(m["at"].alias("at"), F.regexp_extract(m["found"], OPENING, 0).alias("opening"), F.regexp_replace(F.regexp_replace(m["found"], OPENING, ""), CLOSING, "").alias("found"), m["before"].alias("before"), F.concat(F.regexp_extract(m["found"], CLOSING, 0), m["after"]).alias("after")))
    long = F.filter(bare, lambda m: F.length(m["found"]) >= LEAST)
    kind = lambda m: F.when(m["found"].rlike(KEY), SECRET).otherwise(-1)
    start = lambda m: m["at"] + F.length(m["opening"])
    drawn = F.transform(long, lambda m: F.struct(start(m).alias("start"), kind(m).alias("kind"), (start(m) + F.length(m["found"])).alias("end"), F.xxhash64(m["found"]).alias("instance"), _fits(m["found"]).alias("fits"), _patterns(m["before"], m["found"], m["after"]).alias("patterns")))
    meets = lambda b, c: (b["start"] < c["end"]) & (c["start"] < b["end"])
    held = lambda c: F.exists(taken, lambda b: meets(b, c) & F.exists(b["spans"], lambda s: meets(s, c)))
    return F.when(F.size(taken) == 0, drawn).otherwise(F.filter(drawn, lambda c: ~held(c)))


def scored(edges: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """(pattern, kind, confidence, support) of the confident patterns of a graph, edges (pattern, instance, n, kind, fits):
    n occurrences of an instance with a pattern; kind: that of its seeds, -1 for none; fits: the kinds that it may be of."""
    trusted = materialize(edges.where("kind >= 0").groupBy("instance").agg(F.max("kind").alias("trusted")))
    patterns = None
    for last in range(rounds - 1, -1, -1):
        weighed = edges.join(trusted, "instance", "left").groupBy("pattern", "trusted").agg(F.sum("n").alias("good"), F.count("*").alias("support"))
        best = F.max(F.when(F.col("trusted").isNotNull(), F.struct("good", "support", F.col("trusted").alias("kind")))).alias("best")
        found = weighed.groupBy("pattern").agg(F.sum("good").alias("all"), best).select("pattern", "best.kind", (F.col("best.good") / F.col("all")).alias("confidence"), "best.support")
        before, patterns = patterns, materialize(found.where((F.col("support") >= support) & (F.col("confidence") >= confidence)))
        if before is not None:
            discard(before)
        if last:
            learned = edges.where("kind < 0").join(patterns.select("pattern", F.col("kind").alias("trusted")), "pattern").where(_may_be("fits", "trusted")).groupBy("instance").agg(F.max("trusted").alias("trusted"))
            before, trusted = trusted, materialize(trusted.unionByName(learned).groupBy("instance").agg(F.max("trusted").alias("trusted")))
            discard(before)
    discard(trusted)
    return patterns


def find(docs: DataFrame, keep: list[str], rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """The kept columns, base (array of kind, start, end), extra (the same, discovered by context) and secrets (the same,
    keys) of every row."""
    body, seeds, blocks, row, contexts, id_, more = fresh([*keep, "base", "extra", "secrets"], "__text", "__seeds", "__blocks", "__row", "__contexts", "__id", "__extra")
    (said,) = fresh([*keep, body, seeds, blocks], "__said")
    text = F.coalesce(F.col(body), F.lit(""))
    rows = docs.select(*keep, F.col("text").alias(body))
    seen = rows.select(*keep, text.alias(body), entities(text).alias(seeds))
    spans = lambda c: F.transform(c, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    seen = seen.select(*keep, body, seeds, spans(seeds).alias("base")).withColumn(blocks, _blocks(F.col("base")))
    seen = seen.withColumn(said, spelled(F.col(body), blocks)).withColumn(blocks, F.when(F.size(said) > 0, _blocks(F.concat("base", spans(said)))).otherwise(F.col(blocks)))
    found = materialize(seen.select(*keep, "base", F.concat(F.col(seeds), F.col(said), candidates(F.col(body), blocks)).alias(contexts)).withColumn(row, F.monotonically_increasing_id()))

    # the pattern-instance graph, aggregated over all texts
    each = found.select(row, F.explode(contexts).alias("c")).select(F.col(row).alias("row"), "c.*")
    drawn = each.select("kind", "instance", "fits", F.explode("patterns").alias("pattern"))
    edges = materialize(drawn.groupBy("pattern", "instance").agg(F.count("*").alias("n"), F.max("kind").alias("kind"), F.max("fits").alias("fits")))
    patterns = scored(edges, rounds, confidence, support)
    discard(edges)
    free = each.where((F.col("kind") < 0) | (F.col("kind") == SECRET)).select("row", "start", "end", "fits", F.explode("patterns").alias("pattern"))
    named = free.join(patterns.withColumnRenamed("kind", "named"), "pattern").where(_may_be("fits", "named"))
    spans = named.groupBy("row", "start", "end").agg(F.max(F.struct("confidence", "support", "named")).alias("best"))
    one = F.struct("start", F.col("best.named").alias("kind"), "end")
    extra = spans.groupBy(F.col("row").alias(id_)).agg(F.array_sort(F.collect_list(one)).alias(more))

    def of(secret: bool) -> Column:
        own = F.filter(more, lambda s: (s["kind"] == SECRET) == F.lit(secret))
        return F.coalesce(F.transform(own, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))), F.array().cast(SPAN))

    return found.join(extra, F.col(row) == F.col(id_), "left").select(*keep, "base", of(False).alias("extra"), of(True).alias("secrets"))


def written(spans: Column) -> Column:
    """kind:start:end of every span, by start, then kind, comma-joined."""
    names = F.array(*(F.lit(k) for k in NAMES))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def mask(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; spans that overlap are replaced together, by the
    first's kind."""
    names = F.array(*(F.lit(k) for k in NAMES))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    counted = _running(ordered, lambda s: s["end"], lambda a, b: F.greatest(a, b), F.lit(0).cast("bigint"))
    first = F.filter(counted, lambda x: x["item"]["start"] >= x["ahead"])

    def cut(source: Column, part) -> Column:
        pieces = F.transform(first, lambda x: F.concat(part(source, x["ahead"].cast("int") + 1, (x["item"]["start"] - x["ahead"]).cast("int")), F.lit("<"), F.element_at(names, x["item"]["kind"] + 1), F.lit(">")))
        rest = F.array_max(F.transform(spans, lambda s: s["end"])).cast("int") + 1
        return F.concat(F.array_join(pieces, ""), part(source, rest, F.greatest(F.length(text) - rest + 1, F.lit(0))))

    # a substring is counted from the text's beginning; with many spans its characters are told apart once
    split = F.transform(F.array(F.split(text, "")), lambda letters: cut(letters, lambda source, at, n: F.array_join(F.slice(source, at, n), "")))
    whole = cut(text, lambda source, at, n: F.substring(source, at, n))
    return F.when(F.size(spans) == 0, text).when(F.size(spans) > BLOCK, F.element_at(split, 1)).otherwise(whole)


def redact(docs: DataFrame) -> DataFrame:
    """docs with every identifier in text replaced by its kind; null texts stay null, all columns stay, whatever
    their names."""
    spans = find(docs.select(F.struct(*docs.columns).alias("row"), "text"), ["row"])
    masked = F.when(F.col("row.text").isNull(), F.lit(None)).otherwise(mask(F.col("row.text"), F.concat("base", "extra", "secrets")))
    return spans.select(*((masked if c.lower() == "text" else F.col("row")[c]).alias(c) for c in docs.columns))
