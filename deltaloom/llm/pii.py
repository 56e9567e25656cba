"""Personal data by weak supervision, in DataFrame operations only.

Base spans come from four patterns (email, ip, card, phone). Wider patterns propose more candidates: addresses spelled
out or at a bare host, national phone numbers, identity numbers, account numbers, streets, names behind titles, keys and
passwords, grouped digits. Labelers vote on every candidate, base ones included: its shape and what a checker of its kind says
(regex), gazetteers (ends and names of hosts, codes of countries, reserved networks, issuers, streets, roles that are nobody's
own), the words before it (context) and what stands on both sides of it (frame); a vote is 1, -1 or 0 for none.
Expectation-maximisation over the counts of all vote patterns of the corpus estimates how reliable each labeler is, and its
posteriors train the final span classifier, a logistic model of the votes and their pairs; a candidate that it accepts and that
touches no base span is added.

The vote patterns are at most 3^5 rows for base and for other candidates, however large the corpus is; only those reach the
driver. Everything else is a projection over documents, with no shuffle of texts.

Positions are code points, ends exclusive. Matching is by leftmost, non-overlapping matches of each pattern: what lies
between two matches comes from ``split``, the matches from ``regexp_extract_all``, and running lengths give the positions.
Whatever runs over the matches of a text (positions, overlaps, masking) is a scan in two levels: groups of ``CHUNK``, whose
starting states are found first, so that a text of very many matches takes time in proportion to them.

Defined results: a null or empty text has no spans; the hash of no spans is that of the empty string; rows that repeat are
handled alike; a null doc_id is kept as null; of added spans that overlap, the one that starts first stays, then the first by
kind; base spans of different kinds may overlap; a text of any length is searched as a whole; with no candidates in the corpus
nothing is added; other columns are ignored in ``digests`` and unchanged in ``masked``, whatever their names.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Possessive repetition and the look-behind only save time: a run of such characters is tried once, from its start or
# from the end of the match before.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
#: Kinds of other spans, in the order in which spans are listed behind the base ones.
OTHERS = ("id", "iban", "street", "name", "secret", "number")

#: (kind, what a text must have for a look to be worth it, pattern)
WIDER = (
    ("email", "@", r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?![A-Za-z0-9@.-])"),
    ("email", r"[\[(] ?[aA][tT] ?[\])]", r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(] ?dot ?[\])]) ?[A-Za-z0-9-]++)++"),
    ("phone", "[0-9]", r"(?<![0-9A-Za-z+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])"),
    ("id", "[0-9]-[0-9]", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
    ("iban", "[A-Z]{2}[0-9]{2}", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"),
    ("street", "[0-9]", r"(?<![0-9A-Za-z])[0-9]{1,5}[a-z]? (?:\p{Lu}\p{L}+ ){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Square|Court|Way)\b|(?<![\p{L}])\p{Lu}\p{L}+(?:straße|strasse|weg|platz|allee) [0-9]{1,4}[a-z]?\b|\b[0-9]{1,4},? (?:rue|avenue|boulevard|calle|avenida) (?:d[eu] |la |le |del )?\p{Lu}\p{L}+"),
    ("name", "[.a-z] [A-Z]", r"(?<![\p{L}])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\.? \p{Lu}[\p{L}'-]+(?: \p{Lu}[\p{L}'-]+)?"),
    ("secret", "[0-9]", r"(?<![0-9A-Za-z])(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])|(?<![0-9A-Za-z_])(?:gh[opusr]_|sk-|xox[abprs]-)[0-9A-Za-z_-]{16,}|(?i)(?<![0-9a-z])(?:password|passwd|pwd|secret|token|api[_-]?key)\s{0,2}[=:]\s{0,2}[\"']?[^\s\"']{6,}"),
    ("number", "[0-9]{6}", r"(?<![0-9A-Za-z.,+(-])[0-9]{6,12}(?![0-9A-Za-z.,-])"),
)
#: Gazetteers: common ends and names of hosts; roles and hosts that are nobody's own; calling codes; words that announce
#: personal data; words that announce other numbers.
HOST_ENDS = ("com", "org", "net", "edu", "gov", "info", "biz", "io", "me", "co", "de", "fr", "es", "it", "nl", "be", "ch", "at", "pt", "pl", "se", "no", "dk", "fi", "ie", "uk", "eu", "us", "ca", "mx", "br", "ar", "cl", "au", "nz", "jp", "cn", "in", "kr", "ru", "tr", "za")
HOSTS = ("gmail", "googlemail", "yahoo", "hotmail", "outlook", "live", "icloud", "aol", "gmx", "web", "orange", "free", "proton", "protonmail", "mail")
NOBODY = ("noreply", "no-reply", "donotreply", "info", "support", "admin", "postmaster", "webmaster", "abuse", "hostmaster", "sales", "office")
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "61", "64", "81", "82", "86", "90", "91", "351", "353", "358")
CUES = "e-?mail|mail|contact|phone|tel|telephone|call|mobile|cell|fax|reach|write|ssn|social security|passport|card|account|ip|address|name|iban|correo|teléfono|nombre|courriel|téléphone|telefon|anschrift|adresse"
COUNTER_CUES = "isbn|issn|doi|version|build|page|pages|item|order|total|sum|year|id|no|nr|price|part|section|figure|table|line"
LABELERS = ("shape", "checked", "gazetteer", "context", "frame")
#: Matches of a group in a scan, and code points of a piece of a text that is masked.
CHUNK, PIECE = 64, 1_024


def bound(value: Column, use) -> Column:
    """``use(value)``, with ``value`` worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def scan(items: Column, zero: Column, carried, out) -> Column:
    """array of ``out(state, item)``, where each item meets the state that ``carried(state, item)`` made of those before it."""
    start = zero

    def groups(xs: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / CHUNK).cast("int")), lambda g: F.slice(xs, g * CHUNK + 1, CHUNK))

    def append(acc: Column, x: Column) -> Column:
        return F.struct(carried(acc["state"], x).alias("state"), F.concat(acc["out"], F.array(out(acc["state"], x))).alias("out"))

    def states(gs: Column) -> Column:
        step = lambda acc, g: F.struct(F.aggregate(g, acc["state"], carried).alias("state"), F.concat(acc["all"], F.array(acc["state"])).alias("all"))
        return F.aggregate(gs, F.struct(start.alias("state"), F.slice(F.array(start), 1, 0).alias("all")), step, lambda acc: acc["all"])

    def within(gs: Column) -> Column:
        sample = lambda g, state: F.slice(F.transform(g, lambda x: out(state, x)), 1, 0)  # noqa: E731  an empty array of the right type
        run = lambda p: F.aggregate(p["g"], F.struct(p["s"].alias("state"), sample(p["g"], p["s"]).alias("out")), append, lambda acc: acc["out"])
        return F.flatten(F.transform(F.arrays_zip(gs.alias("g"), states(gs).alias("s")), run))

    return bound(items, lambda xs: F.when(F.size(xs) > 0, bound(groups(xs), within)))


def found(text: Column, pattern: str, needs: Column | None = None) -> Column:
    """array<struct<start, end, m, before, after>> of the matches; up to 24 characters in front, up to 12 behind."""
    pieces, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.expr("cast(array() as array<struct<start:int,end:int,m:string,before:string,after:string>>)")

    def rows(z: Column) -> Column:
        items = F.filter(F.arrays_zip(z["pieces"].alias("p"), z["matches"].alias("m"), F.slice(z["pieces"], 2, F.greatest(F.lit(0), F.size(z["pieces"]) - 1)).alias("q")), lambda x: x["m"].isNotNull())
        width = lambda x: F.length(x["p"]) + F.length(x["m"])

        def row(at: Column, x: Column) -> Column:
            start = at + F.length(x["p"])
            return F.struct(start.alias("start"), (at + width(x)).alias("end"), x["m"].alias("m"), F.right(x["p"], F.lit(24)).alias("before"), F.left(x["q"], F.lit(12)).alias("after"))

        return scan(items, F.lit(0), lambda at, x: at + width(x), row)

    spans = bound(F.struct(pieces.alias("pieces"), matches.alias("matches")), rows)
    usable = text.isNotNull() if needs is None else text.isNotNull() & needs
    return F.coalesce(F.when(usable & text.rlike(pattern), spans), empty)


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    chars = F.filter(F.split(F.reverse(number), ""), lambda c: c != "")
    total = F.aggregate(
        F.transform(chars, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0))), F.lit(0), lambda a, x: a + x
    )
    return total % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    has = text.rlike("[0-9]")
    part_ok = lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.right(p, F.lit(3)).try_cast("int"), F.lit(0)) <= 255)
    return {
        "email": found(text, EMAIL, text.contains("@")),
        "ip": F.filter(found(text, IP, has), lambda s: F.forall(F.split(s["m"], r"\."), part_ok)),
        "card": F.filter(found(text, CARD, has), lambda s: F.length(digits(s["m"])).between(16, 19) & luhn(digits(s["m"]))),
        "phone": F.filter(found(text, PHONE, text.contains("+")), lambda s: F.length(digits(s["m"])).between(8, 15)),
    }


def votes(kind: str, s: Column, base: bool) -> Column:
    """The five votes on a candidate, as one number in base 3."""
    m, before, after = s["m"], F.lower(s["before"]), s["after"]
    number = digits(m)

    def vote(good: Column | None = None, bad: Column | None = None) -> Column:
        nothing = F.lit(0) if good is None else F.when(good, 1).otherwise(0)
        return nothing if bad is None else F.when(bad, -1).otherwise(nothing)

    none = F.lit(0)
    word = lambda names: "|".join(names)
    shape = {
        "email": vote(m.rlike(r"(?i)(\.|dot ?[\])] ?)[a-z]{2,}$"), ~m.rlike(r"(?i)(\.|dot ?[\])] ?)[a-z]{2,}$")),
        "ip": vote(~m.rlike(r"(?:^|\.)0[0-9]"), m.rlike(r"(?:^|\.)0[0-9]")),
        "card": vote(m.rlike(r"^[0-9]{16}$|^(?:[0-9]{4}[ -]){3}[0-9]{4}$"), m.rlike(r"[ -][0-9][ -]")),
        "phone": vote(m.rlike(r"^\+?[0-9]{0,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3}"), m.rlike(r"[ .()-]{3}")),
        "id": F.lit(1),
        "iban": vote(F.length(F.regexp_replace(m, " ", "")).between(15, 34), ~F.length(F.regexp_replace(m, " ", "")).between(15, 34)),
        "street": F.lit(1),
        "name": vote(m.rlike(r"\p{L} \p{Lu}\p{L}+ \p{Lu}\p{L}+$")),
        "secret": vote(m.rlike(r"[0-9]") & m.rlike("[A-Za-z]"), ~m.rlike("[0-9]")),
        "number": none,
    }[kind]
    checked = {
        "email": vote(m.rlike(r"^[A-Za-z]")),
        "ip": vote(~m.rlike(r"^(?:0|127|255)\."), m.rlike(r"^(?:0|127|255)\.")),
        "card": vote(number.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"), number.rlike(r"^([0-9])\1{11}")),
        "phone": vote(F.length(number) >= 10, number.rlike(r"^(?:\d{0,3})([0-9])\1{6}")),
        "id": vote(~number.rlike("^(?:000|666|9)") & ~number.rlike("^(?:078051120|219099999)$"), number.rlike("^(?:000|666|9)|^(?:078051120|219099999)$")),
        "iban": vote(m.rlike("[0-9]{6}"), ~m.rlike("[0-9]{4}")),
        "street": vote(m.rlike("[0-9]")),
        "name": vote(~m.rlike(r"(?i) (?:the|and|of|in)$"), m.rlike(r"(?i) (?:the|and|of|in)$")),
        "secret": vote(m.rlike("[0-9].*[A-Za-z].*[0-9]|[A-Za-z].*[0-9].*[A-Za-z]"), m.rlike(r"(?i)[=:]\s*[\"']?(?:none|null|true|false|example)")),
        "number": vote(bad=number.rlike("^(?:19|20)[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])$")),
    }[kind]
    gazetteer = {
        "email": vote(m.rlike(rf"(?i)(?:\.|dot ?[\])] ?)(?:{word(HOST_ENDS)})$|@(?:{word(HOSTS)})$"), m.rlike(rf"(?i)^(?:{word(NOBODY)})(?:@| ?[\[(])")),
        "ip": vote(bad=m.rlike(r"^(?:10|192\.168|172\.(?:1[6-9]|2[0-9]|3[01])|169\.254|22[4-9]|23[0-9])\.")),
        "card": none,
        "phone": vote(m.rlike(rf"^\+(?:{word(CALLING)})(?:\D|[0-9]{{7}})"), m.rlike(r"555[ .-]01[0-9]{2}$")),
        "id": none,
        "iban": vote(m.rlike("^(?:AT|BE|CH|CZ|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)")),
        "street": vote(m.rlike("(?i)(?:street|avenue|road|straße|strasse|rue|calle)")),
        "name": F.lit(1),
        "secret": vote(m.rlike("^(?:AKIA|ASIA|gh[opusr]_|sk-|xox)|(?i)^(?:password|passwd|pwd|secret|token|api)")),
        "number": none,
    }[kind]
    context = vote(before.rlike(rf"(?:^|[^a-zà-ÿ])(?:{CUES})[^a-zà-ÿ0-9]{{0,12}}$"), ~before.rlike(rf"(?:^|[^a-zà-ÿ])(?:{CUES})[^a-zà-ÿ0-9]{{0,12}}$") & before.rlike(rf"(?:^|[^a-zà-ÿ])(?:{COUNTER_CUES})[^a-zà-ÿ0-9]{{0,4}}$"))
    # in brackets or behind a colon it is given as such; between other numbers it may be one of a table
    frame = vote(before.rlike(r"[<(\[:=\"'] ?$") | after.rlike(r"^ ?[>)\]\"']"), before.rlike(r"[0-9][ ,;|\t]{1,3}$") | after.rlike(r"^[ ,;|\t]{1,3}[0-9]"))
    return reduce(lambda a, v: a * 3 + (v + 1), (shape, checked, gazetteer, context, frame), F.lit(0)).cast("int")


def tagged(kind: str, spans: Column, base: bool) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(base).alias("base"), votes(kind, s, base).alias("votes")))


def off_base(wider: Column, base: Column) -> Column:
    """The wider candidates that overlap no base one: swept by start, then backwards."""
    place = lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base"), c["kind"].alias("kind"), c["votes"].alias("votes"))
    far = F.lit(2_147_483_647)
    every = F.array_sort(F.transform(F.concat(base, wider), place))
    ahead = scan(every, F.lit(0), lambda end, x: F.when(x["base"], F.greatest(end, x["end"])).otherwise(end), lambda end, x: F.struct(x.alias("x"), (end > x["start"]).alias("hit")))
    both = scan(F.reverse(ahead), far, lambda start, y: F.when(y["x"]["base"], y["x"]["start"]).otherwise(start), lambda start, y: F.struct(y["x"].alias("x"), (y["hit"] | (start < y["x"]["end"])).alias("hit")))
    free = F.transform(F.filter(both, lambda y: ~y["hit"] & ~y["x"]["base"]), lambda y: F.struct(*[y["x"][c].alias(c) for c in ("kind", "start", "end", "base", "votes")]))
    return F.when((F.size(wider) > 0) & (F.size(base) > 0), free).otherwise(wider)


def candidates(docs: DataFrame) -> DataFrame:
    """``docs`` with base_email .. base_phone (spans) and candidates: all tagged spans, wider ones off base ones."""
    text = F.col("text")
    rows = docs.select("*", *[c.alias(f"base_{k}") for k, c in base_spans(text).items()])
    wider = [(kind, found(text, pattern, text.rlike(needs))) for kind, needs, pattern in WIDER]
    rows = rows.select("*", F.concat(*[tagged(kind, spans, False) for kind, spans in wider]).alias("_wider"), F.concat(*[tagged(k, F.col(f"base_{k}"), True) for k in KINDS]).alias("_base"))
    return rows.withColumn("candidates", F.concat("_base", off_base(F.col("_wider"), F.col("_base")))).drop("_wider", "_base")


def unpacked(code: int) -> list[int]:
    out = []
    for _ in LABELERS:
        out.append(code % 3 - 1)
        code //= 3
    return out[::-1]


def fit(patterns: dict[tuple[int, bool], int], rounds: int = 60) -> dict[int, float]:
    """Vote patterns and their counts -> the classifier's probability for each of them.

    Expectation-maximisation over (prior, P(vote | class) of each labeler), then a logistic model of single votes and pairs
    of votes, fitted to the posteriors by gradient steps. Base candidates are personal by contract and stay so.
    """
    rows = [(unpacked(code), base, n) for (code, base), n in sorted(patterns.items())]
    if not rows:
        return {}
    k = len(LABELERS)
    post = [1.0 if base else 0.5 + 0.4 * max(-1, min(1, sum(v))) for v, base, _ in rows]
    for _ in range(rounds):
        table = [[[1.0] * 3, [1.0] * 3] for _ in range(k)]  # [labeler][class][vote + 1], one made-up count each
        mass = [1.0, 1.0]
        for (v, _, n), q in zip(rows, post):
            for c, share in ((1, q), (0, 1 - q)):
                mass[c] += n * share
                for j in range(k):
                    table[j][c][v[j] + 1] += n * share
        new = []
        for v, base, _ in rows:
            log = [math.log(mass[c]) + sum(math.log(table[j][c][v[j] + 1] / sum(table[j][c])) for j in range(k)) for c in (0, 1)]
            new.append(1.0 if base else 1 / (1 + math.exp(max(-500, min(500, log[0] - log[1])))))
        post = new
    features = [[1.0, *v, *[v[i] * v[j] for i in range(k) for j in range(i)]] for v, _, _ in rows]
    weights, total = [0.0] * len(features[0]), sum(math.sqrt(n) for _, _, n in rows)
    for _ in range(3000):
        slope = [0.0] * len(weights)
        for x, (_, _, n), q in zip(features, rows, post):
            p = 1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(weights, x))))))
            for i, f in enumerate(x):
                slope[i] += math.sqrt(n) * (p - q) * f / total
        weights = [w - 0.5 * (s + 0.001 * w) for w, s in zip(weights, slope)]
    score = lambda x: 1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(weights, x))))))
    return {code: score(x) for (code, _), x in zip(sorted(patterns), features)}


def fitted(docs: DataFrame) -> dict[int, float]:
    votes_of = candidates(docs.select("text")).select(F.explode("candidates").alias("c")).groupBy(F.col("c.votes").alias("votes"), F.col("c.base").alias("base")).count()
    return fit({(r["votes"], r["base"]): r["count"] for r in votes_of.collect()})  # 2 * 3^5 rows at most


def with_spans(docs: DataFrame, model: dict[int, float] | None = None, least: float = 0.8) -> DataFrame:
    """``docs`` with base_<kind> and spans: array<struct<kind, start, end>>, by kind as listed, then start."""
    model = fitted(docs) if model is None else model
    accepted = [c for c, p in model.items() if p >= least]
    good = F.array(*[F.lit(c) for c in accepted]) if accepted else F.expr("cast(array() as array<int>)")
    order = F.create_map(*[x for i, kind in enumerate((*KINDS, *OTHERS)) for x in (F.lit(kind), F.lit(i))])
    rows = candidates(docs)
    kept = F.filter("candidates", lambda c: c["base"] | F.array_contains(good, c["votes"]))
    rows = rows.withColumn("_kept", F.transform(kept, lambda c: F.struct(order[c["kind"]].alias("o"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), c["base"].alias("base"))))
    # an added span gives way to an earlier one that it touches; base spans of different kinds may touch each other
    by_start = F.array_sort(F.transform(F.filter("_kept", lambda c: ~c["base"]), lambda c: F.struct(c["start"].alias("start"), c["o"].alias("o"), c["end"].alias("end"), c["kind"].alias("kind"))))
    swept = scan(by_start, F.lit(0), lambda end, x: F.greatest(end, x["end"]), lambda end, x: F.struct(x.alias("x"), (end > x["start"]).alias("hit")))
    span = lambda o, c: F.struct(o.alias("o"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"))
    added = F.transform(F.filter(swept, lambda y: ~y["hit"]), lambda y: span(y["x"]["o"], y["x"]))
    own = F.transform(F.filter("_kept", lambda c: c["base"]), lambda c: span(c["o"], c))
    ordered = F.array_sort(F.when(F.size(by_start) > 0, F.concat(own, added)).otherwise(own))
    return rows.withColumn("spans", F.transform(ordered, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))).drop("_kept", "candidates")


def written_out(spans: Column, kind: Column | None = None) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind if kind is not None else s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame, model: dict[int, float] | None = None) -> DataFrame:
    rows = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    parts = [written_out(F.col(f"base_{k}"), F.lit(k)) for k in KINDS]
    base = F.array_join(F.filter(F.array(*parts), lambda p: p != ""), ",")
    return rows.select("doc_id", *[F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(base, 256).alias("base_sha256"), written_out(F.col("spans")).alias("spans"))


def masked(docs: DataFrame, model: dict[int, float] | None = None) -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in brackets, and n_chars, if there is one, of the new text."""
    rows = with_spans(docs.select(F.struct("*").alias("row"), "text"), model)  # so that no column of theirs clashes with ours
    # spans by start; one that begins inside what is already masked only lengthens it
    spans = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def masked_text(x: Column) -> Column:
        """What lies between the spans, from pieces of the text of which a position is found at once."""

        def between(start: Column, end: Column) -> Column:
            first = F.floor(start / PIECE).cast("int")
            near = F.array_join(F.slice(x["pieces"], first + 1, F.floor(end / PIECE).cast("int") - first + 1), "")
            return F.substring(near, start - first * PIECE + 1, end - start)

        def out(at: Column, s: Column) -> Column:
            return F.when(s["start"] >= at, F.concat(between(at, s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")

        last = F.array_max(F.transform(x["spans"], lambda s: s["end"]))
        return F.concat(F.array_join(scan(x["spans"], F.lit(0), lambda at, s: F.greatest(at, s["end"]), out), ""), between(last, F.length(F.col("text"))))

    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    found = F.size("spans") > 0
    text = bound(F.struct(spans.alias("spans"), pieces.alias("pieces")), masked_text)
    rows = rows.select("row", found.alias("found"), F.when(found, text).otherwise(F.col("text")).alias("text"))
    own = lambda c: F.col("row").getField(c)
    new = {"text": F.col("text"), "n_chars": F.when(F.col("found"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(own("n_chars")) if "n_chars" in docs.columns else None}
    return rows.select(*[(own(c) if new.get(c) is None else new[c]).alias(c) for c in docs.columns])
