"""Personal data by weak supervision; DataFrame functions only.

Strict patterns give the base spans, wide patterns give further candidates. Four labelers
vote for, against or not at all on every candidate: a structure check, a shape labeler, a
gazetteer and a context labeler, which knows a few words and learns others from the counts of
what stands before base spans and before other candidates of their kind. No vote repeats a
base pattern. The votes of the whole table are counted per
kind, and expectation-maximisation estimates from the counts how reliable each labeler is
and how likely each vote pattern is personal data. With these soft labels a naive Bayes span
classifier is trained on span features, again from counts. Base spans stay; the classifier
decides on the others. Only counts over a fixed grid of votes and features reach the driver.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.llm.common import durable

KINDS = ("email", "ip", "card", "phone")
#: The strict patterns. Possessive where no backtracking can change the match, so that long runs cost linear time; a card's
#: has the number of digits that it may have, as longer and shorter runs would be dropped.
BASE = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
#: What a text must match for its strict pattern to be tried, for speed alone.
GUARD = ("@", r"\.[0-9]", "[0-9]", r"\+[0-9]")
#: Candidates beyond the strict patterns: spelled-out addresses, defanged addresses and IPv6, grouped card numbers, national phone numbers.
WIDE = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?: ?[\[({](?:at|AT|@)[\])}] ?| at | @ )[A-Za-z0-9-]++(?:(?: ?[\[({](?:dot|DOT|\.)[\])}] ?| dot |\.)[A-Za-z0-9-]++)++",
    r"(?<![0-9A-Fa-f:.])(?:(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,5}:(?:[0-9A-Fa-f]{1,4}:){0,4}[0-9A-Fa-f]{1,4}|[0-9]{1,3}(?: ?[\[(]\.[\])] ?[0-9]{1,3}){3})(?![0-9A-Fa-f:])",
    r"(?<![0-9.])[0-9]{4}[.\x20-][0-9]{4}[.\x20-][0-9]{4}(?:[.\x20-][0-9]{1,7})?(?![0-9])",
    r"(?<![0-9A-Za-z+./-])(?:00[1-9][0-9]{0,2}[\x20-])?\(?[0-9]{2,5}\)?(?:[\x20-][0-9]{3,4}[\x20-][0-9]{3,4}|\.[0-9]{3}\.[0-9]{4}|[/\x20][0-9]{6,8})(?![0-9A-Za-z/-])",
)
WIDE_GUARD = (r"[\[({](?:at|AT|@)[\])}]| dot | @ ", r"[0-9A-Fa-f]:[0-9A-Fa-f:]|[0-9] ?[\[(]\.", "[0-9]{4}[.\x20-][0-9]{4}", r"[0-9]{2}\)?[\x20./-][0-9]{3}")
#: Gazetteer: domain endings, leading digits of card issuers, calling codes. Fixed values.
DOMAINS = """
com org net edu gov int mil info biz name pro io ai app dev cloud online site tech store shop blog
ac ad ae ar at au ba be bg bo br by ca ch cl cn co cr cu cy cz de dk do ec ee eg es eu fi fr gr gt hk hr
hu id ie il in ir is it jp ke kr kz lt lu lv ma me mt mx my ng ni nl no nz pa pe ph pk pl pr pt py ro rs
ru sa se sg si sk sv th tn tr tv tw ua uk us uy ve vn za
""".split()
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|36|38)"
CALLING = r"^(?:00)?(?:1|7|2[07]|3[0-4]|36|39|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
#: Context words before a span, for and against, in the corpus languages. Fixed values.
FOR = (
    r"mail|contact|kontakt|contacto|adres|write to",
    r"\bip\b|host|server|serveur|servidor|address|adresse",
    r"card|karte|carte|tarjeta|visa|credit|kredit|payment",
    r"phone|tel|call|fax|mobile|handy|móvil|appel|llama|rufen",
)
AGAINST = (r"://[^ ]*$", r"version|\bv\.? ?$|release|section|kapitel", r"token|hash|serial|isbn|order|invoice|\bid\b", r"token|isbn|version|page|date|order|\bid\b")
#: Words before spans whose votes are learned, for each kind at most; seen so often at least; log odds beyond which one votes.
CUES, CUE_LEAST, CUE_ODDS = 100, 20, 1.0
#: Characters of context.
NEAR = 32
#: Where a span lies: in code points, and in bytes.
PLACE = ("start", "kind", "end", "byte", "last")
LABELERS = ("check", "shape", "gazetteer", "context")
FEATURES = ("digits", "marks", "before", "after", "gazetteer", "context", "check")
ROUNDS = 50
#: Elements that a fold may append one by one; longer arrays are folded by blocks of so many.
RUN = 512
#: Digits beyond which no check sum is taken.
LONGEST_NUMBER = 32


def let(value: Column, f) -> Column:
    """``f`` of ``value``, which is computed once even if ``f`` uses it within lambdas."""
    return F.element_at(F.transform(F.array(value), f), 1)


def running(xs: Column, start: Column, add) -> Column:
    """What ``add`` makes of each element and all before it, from ``start``, its neutral value.

    A fold that appends copies what it has, so the array is folded by blocks, and the
    blocks' last values once more: in effect linear up to millions of elements.
    """

    def fold(part):
        zero = F.struct(start.alias("at"), F.filter(F.array(start), lambda _: F.lit(False)).alias("out"))
        return F.aggregate(part, zero, lambda a, x: let(add(a["at"], x), lambda v: F.struct(v.alias("at"), F.array_append(a["out"], v).alias("out"))), lambda a: a["out"])

    def joined(blocks):
        before = fold(F.transform(blocks, lambda b: F.coalesce(F.try_element_at(b, F.lit(-1)), start)))
        return let(before, lambda ends: F.flatten(F.transform(blocks, lambda b, i: let(F.coalesce(F.get(ends, i - 1), start), lambda e: F.transform(b, lambda x: add(e, x))))))

    def cut(v):
        last = F.floor((F.greatest(F.size(v), F.lit(1)) - 1) / RUN).cast("int")
        return let(F.transform(F.sequence(F.lit(0), last), lambda b: fold(F.slice(v, b * RUN + 1, F.lit(RUN)))), joined)

    return let(xs, cut)


def sums(xs: Column) -> Column:
    """Running sums of both numbers of structs (a, b)."""
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    return running(xs, pair(F.lit(0), F.lit(0)), lambda x, y: pair(x["a"] + y["a"], x["b"] + y["b"]))


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """The check sum of a string of digits holds."""

    def worth(i):
        d = F.substring(number, F.length(number) - i, F.lit(1)).try_cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    at = F.sequence(F.lit(0), F.greatest(F.length(number) - 1, F.lit(0)))
    return F.coalesce(F.when(F.length(number) <= LONGEST_NUMBER, F.aggregate(at, F.lit(0), lambda s, i: s + worth(i)) % 10 == 0), F.lit(False))


def octets(s: Column) -> Column:
    bare = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    return F.forall(F.split(s, r"\."), lambda p: (F.length(bare(p)) <= 3) & (F.try_to_number(F.right(bare(p), F.lit(3)), F.lit("999")) <= 255))


def valid(kind: int, s: Column) -> Column:
    """The strict pattern's further condition."""
    n = F.length(digits(s))
    return (F.lit(True), octets(s), n.between(14, 19) & luhn(digits(s)), n.between(10, 15))[kind]


def _found(text: Column) -> Column:
    """All patterns' matches as one array of spans for each, with what precedes and follows; the strict ones valid."""

    def spans(x):
        size = lambda s, i: F.struct((F.length(F.get(x["g"], i)) + F.length(s)).alias("a"), (F.octet_length(F.get(x["g"], i)) + F.octet_length(s)).alias("b"))

        def placed(s, i, e):
            place = ((e["a"] - F.length(s)), x["kind"], e["a"], (e["b"] - F.octet_length(s)), e["b"])
            more = (x["base"].alias("base"), s.alias("s"), F.right(F.get(x["g"], i), F.lit(NEAR)).alias("before"), F.left(F.get(x["g"], i + 1), F.lit(1)).alias("after"))
            return F.struct(*(p.alias(c) for p, c in zip(place, PLACE, strict=True)), *more)

        every = let(sums(F.transform(x["m"], size)), lambda ends: F.transform(x["m"], lambda s, i: placed(s, i, F.get(ends, i))))
        holds = lambda c: F.when(~c["base"] | (c["kind"] == 0), True).when(c["kind"] == 1, valid(1, c["s"])).when(c["kind"] == 2, valid(2, c["s"])).otherwise(valid(3, c["s"]))
        return F.filter(every, holds)

    def matched(kind, pattern, guard, base):
        return F.when(text.rlike(guard), F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"), F.lit(kind).alias("kind"), F.lit(base).alias("base")))

    tried = [matched(k, p, g, base) for patterns, guards, base in ((BASE, GUARD, True), (WIDE, WIDE_GUARD, False)) for k, (p, g) in enumerate(zip(patterns, guards, strict=True))]
    return F.transform(F.filter(F.array(*tried), lambda x: x.isNotNull()), spans)


def _votes(c: Column) -> Column:
    """The labelers' votes, 1, 0 or -1, and the features of a candidate."""
    kind, s, near = c["kind"], c["s"], F.lower(c["before"])
    by_kind = lambda xs: F.get(F.array(*xs), kind)
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    d = digits(s)
    n = F.length(d)
    local = F.regexp_extract(s, r"^([^@\[({ ]*)", 1)
    tidy = ~local.rlike(r"^[.%+-]|[.%+-]$|\.\.") & s.rlike(r"[A-Za-z]{2,24}$")
    octet = F.filter(F.split(F.regexp_replace(s, r"[^0-9.]", ""), r"\."), lambda x: x != "")
    plain = F.when(s.contains(":"), ~s.rlike(":::")).otherwise((F.size(octet) == 4) & F.forall(octet, lambda x: ~x.rlike("^0.") & (F.length(x) <= 3)))
    kinds = F.size(F.array_distinct(F.split(d, "")))
    check = by_kind([vote(tidy, s.rlike("(?:^|[.@])[.-]|[0-9]$")), vote(plain, s.rlike(r"(?:^|\.)0[0-9]")), vote(luhn(d), n > 0), vote((kinds >= 4) & n.between(9, 15), kinds <= 2)])
    shape = by_kind([vote(s.rlike("[A-Za-z]{2}.*[A-Za-z]{2}"), ~s.rlike("[A-Za-z]")), vote(s.rlike("^[1-9]") | s.contains(":"), s.rlike(r"^0|\b0[0-9]")), vote(n.between(15, 16), n < 13), vote(n.between(10, 13), (n < 9) | (n > 15))])
    ending = F.lower(F.regexp_extract(s, r"(?<![A-Za-z])([A-Za-z]++)[^A-Za-z]*+$", 1))
    gazetteer = by_kind([vote(ending.isin(*DOMAINS), F.length(ending) < 2), vote(~s.rlike(r"^(?:0|127|255)\."), s.rlike(r"^(?:0|255)\.")), vote(d.rlike(ISSUERS), d.rlike("^[0789]")), vote(d.rlike(CALLING), F.lit(False))])
    pro, contra = by_kind([near.rlike(p) for p in FOR]), by_kind([near.rlike(p) for p in AGAINST])
    context = vote(pro & ~contra, contra & ~pro)
    edge = lambda x: F.when(x == "", "e").when(x.rlike(r"\s"), "s").when(x.rlike(r"[\p{L}\p{N}]"), "w").otherwise("p")
    return F.struct(*(c[p].alias(p) for p in PLACE), c["base"], check.alias("check"), shape.alias("shape"), gazetteer.alias("gazetteer"), context.alias("context"), F.least(n, F.lit(20)).alias("digits"), F.least(F.length(F.regexp_replace(s, r"[\p{L}\p{N}]", "")), F.lit(8)).alias("marks"), edge(F.right(c["before"], F.lit(1))).alias("before"), edge(c["after"]).alias("after"), F.regexp_extract(near, r"(\p{L}{2,20})[^\p{L}]*$", 1).alias("cue"))


def _apart(base: Column, wide: Column) -> Column:
    """The wide spans that meet no base one: as many of these have begun before such a span's end as have ended before it.

    Both ends of all spans are sorted together and counted along.
    """
    event = lambda at, turn, i: F.struct(at.alias("at"), F.lit(turn).alias("turn"), i.alias("i"))
    none = F.lit(-1)
    ends = F.concat(F.transform(base, lambda c: event(c["end"], 0, none)), F.transform(wide, lambda c, i: event(c["start"], 1, i)), F.transform(wide, lambda c, i: event(c["end"], 2, i)), F.transform(base, lambda c: event(c["start"], 3, none)))

    def free(events):
        counts = sums(F.transform(events, lambda e: F.struct((e["turn"] == 0).cast("int").alias("a"), (e["turn"] == 3).cast("int").alias("b"))))
        seen = F.filter(F.zip_with(events, counts, lambda e, n: F.struct(e["i"].alias("i"), e["turn"].alias("turn"), n["a"].alias("a"), n["b"].alias("b"))), lambda e: e["i"] >= 0)
        return let(F.array_sort(seen), lambda x: F.filter(wide, lambda c, i: F.get(x, 2 * i)["a"] == F.get(x, 2 * i + 1)["b"]))

    return F.when((F.size(base) == 0) | (F.size(wide) == 0), wide).otherwise(let(F.array_sort(ends), free))


def candidates(text: Column) -> Column:
    """All candidate spans of a text, the base ones and the wide ones apart from them, by start and kind."""
    of = lambda found, base: F.flatten(F.filter(found, lambda x: F.coalesce(F.get(x, 0)["base"] == base, F.lit(False))))
    both = let(_found(F.coalesce(text, F.lit(""))), lambda found: F.struct(of(found, True).alias("b"), of(found, False).alias("w")))
    return F.array_sort(F.transform(let(both, lambda x: F.concat(x["b"], _apart(x["b"], x["w"]))), _votes))


def reliabilities(counts: list[dict]) -> dict[tuple, float]:
    """Probability of personal data by (kind, votes): expectation-maximisation for two classes and independent labelers.

    Starts from the strict check and the majority of votes; every probability is smoothed by
    one pseudo-count.
    """
    out = {}
    for kind in range(len(KINDS)):
        cells: dict[tuple, float] = defaultdict(float)
        for r in counts:
            if r["kind"] == kind:
                cells[(r["base"], *(r[x] for x in LABELERS))] += r["n"]
        post = {v: 0.95 if v[0] else 0.6 if sum(v[1:]) > 1 else 0.15 for v in cells}
        for _ in range(ROUNDS if cells else 0):
            total = sum(cells.values())
            prior = (sum(n * post[v] for v, n in cells.items()) + 1) / (total + 2)
            given = {}
            for j in range(len(LABELERS)):
                for c in (0, 1):
                    mass = {x: 1.0 for x in (-1, 0, 1)}
                    for v, n in cells.items():
                        mass[v[1 + j]] += n * (post[v] if c else 1 - post[v])
                    given |= {(j, c, x): m / sum(mass.values()) for x, m in mass.items()}
            for v in cells:
                odds = math.log(prior) - math.log(1 - prior) + sum(math.log(given[j, 1, x]) - math.log(given[j, 0, x]) for j, x in enumerate(v[1:]))
                post[v] = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
        out |= {(kind, *v): p for v, p in post.items()}
    return out


def train(counts: list[dict]) -> dict[str, float]:
    """Weights of the span classifier by "feature|kind|value": log odds of naive Bayes under the soft labels."""
    soft = reliabilities(counts)
    weights = {}
    for kind in range(len(KINDS)):
        own = [r for r in counts if r["kind"] == kind]
        of = lambda r: soft[(r["kind"], r["base"], *(r[x] for x in LABELERS))]
        yes = sum(r["n"] * of(r) for r in own) + 1
        no = sum(r["n"] * (1 - of(r)) for r in own) + 1
        weights[f"prior|{kind}|"] = math.log(yes / no)
        for f in FEATURES:
            mass: dict = defaultdict(lambda: [1.0, 1.0])
            for r in own:
                mass[r[f]][0] += r["n"] * of(r)
                mass[r[f]][1] += r["n"] * (1 - of(r))
            for value, (a, b) in mass.items():
                weights[f"{f}|{kind}|{value}"] = math.log(a / (yes + len(mass))) - math.log(b / (no + len(mass)))
    return weights


def learned_cues(flat: DataFrame) -> dict[str, int]:
    """Votes of the commonest words before candidates, by "kind|word": +1 where base spans are far more frequent after it than after others, -1 where far less."""
    base = F.sum(F.col("base").cast("int"))
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "cue"))
    counts = flat.groupBy("kind", "cue").agg(F.count("*").alias("n"), base.alias("yes"))
    whole = counts.groupBy("kind").agg(F.sum("n").alias("all"), F.sum("yes").alias("all_yes"))
    often = counts.filter((F.col("cue") != "") & (F.col("n") >= CUE_LEAST)).withColumn("place", place).filter(F.col("place") <= CUES)
    odds = lambda yes, n: math.log((yes + 1) / (n - yes + 1))
    out = {}
    for r in often.join(F.broadcast(whole), "kind").collect():
        lead = odds(r.yes, r.n) - odds(r.all_yes, r["all"])
        if abs(lead) > CUE_ODDS:
            out[f"{r.kind}|{r.cue}"] = 1 if lead > 0 else -1
    return out


def _context(c, cues: dict[str, int]) -> Column:
    """The context vote: that of the known words, or else of the learned one."""
    if not cues:
        return c["context"]
    table = F.create_map(*[F.lit(x) for kv in sorted(cues.items()) for x in kv])
    learned = F.try_element_at(table, F.concat_ws("|", c["kind"].cast("string"), c["cue"]))
    return F.when(c["context"] != 0, c["context"]).otherwise(F.coalesce(learned, F.lit(0)))


def fit(spans: DataFrame) -> tuple[dict[str, float], dict[str, int]]:
    """Classifier weights and learned context words from the ``spans`` column of all rows."""
    keys = ["kind", "base", *LABELERS, "digits", "marks", "before", "after"]
    flat = spans.select(F.explode("spans").alias("c")).select("c.*")
    cues = learned_cues(flat)
    seen = flat.withColumn("context", _context({c: F.col(c) for c in ("context", "kind", "cue")}, cues))
    return train([r.asDict() for r in seen.groupBy(*keys).agg(F.count("*").alias("n")).collect()]), cues


def accepted(spans: Column, fitted: tuple[dict[str, float], dict[str, int]]) -> Column:
    """The base spans and those that the classifier accepts."""
    weights, cues = fitted
    table = F.create_map(*[F.lit(x) for kv in sorted(weights.items()) for x in kv])
    weight = lambda f, c, v: F.coalesce(F.try_element_at(table, F.concat_ws("|", F.lit(f), c["kind"].cast("string"), v)), F.lit(0.0))
    value = lambda f, c: (_context(c, cues) if f == "context" else c[f]).cast("string")
    score = lambda c: sum((weight(f, c, value(f, c)) for f in FEATURES), weight("prior", c, F.lit("")))
    return F.filter(spans, lambda c: c["base"] | (score(c) > 0))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", F.get(kinds, c["kind"]), c["start"].cast("string"), c["end"].cast("string"))), ",")


def pii_spans(docs: DataFrame) -> DataFrame:
    """Personal data in every row of ``docs`` (doc_id, text; other columns are ignored).

    Returns doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256 (of the base
    spans as written in ``spans``) and spans (all, as kind:start:end by start and kind,
    offsets in code points). Null and empty texts have none. Repeated rows return
    repeatedly, an empty table gives an empty table and trains nothing.
    """
    spans = durable(docs.select("doc_id", candidates(F.col("text").cast("string")).alias("spans")))
    kept = spans.select("doc_id", accepted(F.col("spans"), fit(spans)).alias("spans"))
    base = F.filter("spans", lambda c: c["base"])
    number = lambda k: F.size(F.filter("spans", lambda c: c["base"] & (c["kind"] == k))).cast("long")
    counts = [number(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return kept.select("doc_id", *counts, F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in brackets; overlapping spans count as one.

    Same columns as ``docs``; n_chars, where there is such a column, follows the text. Texts
    without spans, null ones too, stay as they are. The candidates are written beside the
    rows once; the classifier is trained on the counts of all of them first.
    """
    found = durable(docs.select(F.struct("*").alias("row"), candidates(F.col("text").cast("string")).alias("spans")))
    weights = fit(found)
    labels = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def merge(spans):
        reach = running(F.transform(spans, lambda c: c["last"]), F.lit(0), F.greatest)
        begins = lambda far: F.filter(F.sequence(F.lit(0), F.size(spans) - 1), lambda i: F.get(spans, i)["byte"] >= F.coalesce(F.get(far, i - 1), F.lit(0)))
        groups = lambda far, at: F.transform(at, lambda i, k: F.struct(F.get(spans, i)["byte"].alias("byte"), F.get(far, F.coalesce(F.get(at, k + 1), F.size(spans)) - 1).alias("last"), F.get(spans, i)["kind"].alias("kind")))
        return let(reach, lambda far: let(begins(far), lambda at: groups(far, at)))

    def cover(text, spans):
        part = lambda b, at, n: F.substring(b, at + 1, n).cast("string")
        piece = lambda b, c, i: let(F.when(i > 0, F.get(spans, i - 1)["last"]).otherwise(0), lambda at: F.concat(part(b, at, c["byte"] - at), F.get(labels, c["kind"])))
        return let(text.cast("binary"), lambda b: F.concat(F.array_join(F.transform(spans, lambda c, i: piece(b, c, i)), ""), part(b, F.element_at(spans, -1)["last"], F.octet_length(text))))

    was = F.col("row.text")
    text = F.when(was.isNotNull(), let(accepted(F.col("spans"), weights), lambda m: F.when(F.size(m) > 0, let(merge(m), lambda c: cover(was, c))).otherwise(was)))
    out = found.withColumn("text", text)
    new = {"text": F.col("text"), "n_chars": F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*[(F.col(f"row.`{c}`") if new.get(c) is None else new[c]).alias(c) for c in docs.columns])
