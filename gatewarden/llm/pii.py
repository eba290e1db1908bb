"""Personal data by weak supervision, with DataFrame functions only.

Base spans (email, ip, card, phone) follow fixed rules. Beyond them, candidate spans are judged: long mixed tokens
(secrets), phone numbers without a country code, runs of capitalised words (persons) and account or identity numbers.
Candidates that overlap a base span go first. Five regex, gazetteer and context labelers of each kind vote yes, no or
nothing, often against each other; expectation-maximisation estimates each labeler's reliability from how often each
pattern of votes occurs (a table of at most 3**5 patterns and 21 lengths a kind, the only thing that leaves the
executors). Where votes cannot tell labelers apart (few patterns, no disagreement, or one class only) the estimates
mean nothing, and fixed reliabilities with a low prior are taken instead; the resulting probabilities train a logistic span classifier over the votes and the span's length, which
is applied as an expression. A model is fitted on the texts given to `train` (the query and the pipeline take all of
theirs); with one model a text has the same spans whatever stands beside it.

Defined results: null and empty texts have no spans; of added spans that overlap, the kind listed first stays;
repeated rows are judged alike; extra columns stay, and those named like a result are replaced; with no candidate at
all the classifier says no; an empty table gives an empty table. The matches of a text are placed in parts of PART, so
that no long array is copied for each match; overlaps are still sought by comparing its candidates with its base spans
and the added ones with each other, which grows with the product of their numbers in one text.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KINDS = ["email", "ip", "card", "phone", "secret", "local_phone", "person", "account"]
BASE = KINDS[:4]
SECRET_KIND, LOCAL_KIND, PERSON_KIND, ACCOUNT_KIND = ADDED = (4, 5, 6, 7)
# Fixed patterns of the base kinds, written so that no part is tried twice over one run of characters.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
DIGIT_RUN = r"[0-9][0-9 -]{10,}[0-9]"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
# Patterns of the candidates.
SECRET = r"(?<![0-9A-Za-z_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[0-9A-Za-z_-]{16,}+"
LOCAL_PHONE = r"(?<![0-9A-Za-z+().-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])"
PERSON = r"(?<![\p{L}\p{N}])\p{Lu}\p{Ll}{1,20}(?: \p{Lu}\.| \p{Lu}\p{Ll}{1,20}){1,3}+(?![\p{L}\p{N}])"
ACCOUNT = r"(?<![0-9A-Za-z+.-])(?:[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}+(?: ?[0-9A-Z]{1,3})?+|[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{1,2}[0-9]{6,9}|[0-9]{8,11})(?![0-9A-Za-z-])"
# Fixed word lists of the gazetteer and context labelers.
SECRET_WORDS = ["token", "secret", "password", "passwd", "apikey", "api_key", "access_key", "bearer", "key", "auth"]
PHONE_WORDS = ["tel", "phone", "call", "mobile", "cell", "fax", "contact", "telefon", "anruf"]
NAME_WORDS = ["name", "named", "called", "signed", "by", "dear", "contact", "author", "patient", "employee", "customer", "resident", "sincerely", "regards"]
PLACE_WORDS = ["in", "at", "near", "the", "to", "of", "from", "on"]
ACCOUNT_WORDS = ["account", "acct", "iban", "konto", "kontonummer", "ssn", "social security", "passport", "ausweis", "tax id", "license", "member"]
NUMBER_WORDS = ["isbn", "issn", "doi", "order", "invoice", "version", "article", "issue", "page", "ticket", "build", "item", "sku"]
GIVEN = [
    "Adam", "Alice", "Amy", "Andrea", "Andrew", "Anna", "Anne", "Antonio", "Barbara", "Brian", "Carlos", "Carol", "Charles", "Chris", "Claire", "Daniel", "David", "Diana", "Edward",
    "Elena", "Elizabeth", "Emily", "Emma", "Eric", "Eva", "Fatima", "Frank", "George", "Hans", "Helen", "Henry", "Jack", "James", "Jane", "Jean", "Jennifer", "Jessica", "John", "Jose",
    "Joseph", "Juan", "Julia", "Karen", "Karl", "Kevin", "Laura", "Linda", "Lisa", "Lucy", "Luis", "Maria", "Marie", "Mark", "Martin", "Mary", "Michael", "Mohammed", "Nancy", "Olivia",
    "Patricia", "Paul", "Peter", "Pierre", "Rachel", "Richard", "Robert", "Rosa", "Sarah", "Sofia", "Stephen", "Susan", "Thomas", "Wei", "William",
]
NOT_NAMES = [
    "January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday",
    "Saturday", "Sunday", "The", "United", "National", "New", "North", "South", "East", "West", "University", "College", "Avenue", "Road", "Park", "River", "Lake", "Mount", "City",
    "County", "Company", "Corporation", "Institute", "Museum", "Bank", "Court", "Church", "Bridge", "Island", "Airport", "Station", "Chapter", "Table", "Figure", "Section", "Version", "Apache", "License", "Licence", "Public", "General", "Creative", "Commons", "Foundation", "Software", "Copyright",
    "Rights", "Terms", "Conditions", "Privacy", "Policy", "Agreement", "Notice", "Tower", "Hall", "House", "Castle", "School", "Hospital", "Hotel", "Library", "Theatre", "Theater",
    "Street", "Square", "Valley", "Mountain", "Sea", "Ocean", "Coast", "Bay", "Republic", "Kingdom", "States", "Council", "Committee", "Ministry", "Department", "Office", "Agency",
    "Association", "Society", "Union", "League", "Club", "Group", "Inc", "Ltd", "Limited", "Systems", "Services", "Research", "Press", "Times", "News", "Journal", "Review", "Act", "Law",
]
LABELERS = 5
#: Vote patterns of a kind, and share of candidates in either class, from which the estimates are taken.
PATTERNS, CLASS_SHARE = 6, 0.01
#: Otherwise: the share of true candidates, and the chances of no, nothing and yes for true and for false ones.
PRIOR, TRUE_VOTES, FALSE_VOTES = 0.1, (0.1, 0.3, 0.6), (0.5, 0.4, 0.1)
#: Added spans need at least this probability.
LEAST = 0.9
#: Matches of a text are placed in parts of so many, and the parts then moved.
PART = 256


def find_all(text: Column, pattern: str, context: bool = False) -> Column:
    """array<struct<start, text>> of the leftmost non-overlapping matches, starts in code points; with context also
    up to 32 characters before and 16 after, as far as the next match."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1)
    pairs = F.arrays_zip(gaps.alias("gap"), found.alias("hit"), F.slice(gaps, F.lit(2), F.size(gaps)).alias("next"))
    names = ["start", "text", *(["before", "after"] if context else [])]
    fields = "start: int, text: string" + (", before: string, after: string" if context else "")
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<struct<{fields}>>").alias("out"))

    def one(acc, x):
        around = [F.substring(x["gap"], -32, 32).alias("before"), F.substring(F.coalesce(x["next"], F.lit("")), 1, 16).alias("after")] if context else []
        return F.struct((acc["at"] + F.char_length(x["gap"])).alias("start"), x["hit"].alias("text"), *around)

    def step(acc, x):
        return F.struct(
            (acc["at"] + F.char_length(x["gap"]) + F.coalesce(F.char_length(x["hit"]), F.lit(0))).alias("at"),
            F.when(x["hit"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], one(acc, x))).alias("out"),
        )

    def joined(parts: Column) -> Column:
        """Spans of all parts, moved by what stands before their part."""
        offsets = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda acc, p: F.struct((acc["at"] + p["at"]).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")))["out"]
        moved = lambda o: lambda x: F.struct((x["start"] + o).alias("start"), *(x[k].alias(k) for k in names[1:]))
        return F.flatten(F.zip_with(parts, offsets, lambda p, o: F.transform(p["out"], moved(o))))

    def cut(whole: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(whole), F.lit(PART))
        return F.transform(starts, lambda k: F.aggregate(F.slice(whole, k, F.lit(PART)), empty, step))

    spans = F.element_at(F.transform(F.array(F.element_at(F.transform(F.array(pairs), cut), 1)), joined), 1)
    return F.when(F.size(found) > 0, spans).otherwise(empty["out"])


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Luhn's sum of at most 19 digits ends in 0."""
    parts = F.transform(F.split(F.reverse(digits), ""), lambda c, k: F.when(k % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(parts, F.lit(0), lambda a, b: a + b) % 10 == 0


def _card(x: Column) -> Column:
    d = _digits(x)
    return F.when(F.char_length(d).between(12, 19), _luhn(d)).otherwise(False)


def _ip(x: Column) -> Column:
    def small(part):
        p = F.regexp_replace(part, "^0+(?=.)", "")
        return F.when(F.char_length(p) <= 3, p.cast("int") <= 255).otherwise(False)

    return F.forall(F.split(x, r"\."), small)


def _cards(text: Column) -> Column:
    """Chains of digits with single separators: runs of digits and separators, cut at double separators."""
    runs = find_all(text, DIGIT_RUN)
    return F.flatten(F.transform(runs, lambda r: F.transform(find_all(r["text"], r"[0-9]+(?:[ -](?=[0-9])[0-9]+)*+"), lambda p: F.struct((r["start"] + p["start"]).alias("start"), p["text"].alias("text")))))


def base_spans(text: Column) -> Column:
    """array<struct<start, end, kind, text>> of all base spans, in order of start and kind."""
    none = F.array().cast("array<struct<start: int, text: string>>")
    digit = text.rlike("[0-9]")
    found = [
        F.when(text.contains("@"), find_all(text, EMAIL)).otherwise(none),
        F.when(digit, F.filter(find_all(text, IP), lambda x: _ip(x["text"]))).otherwise(none),
        F.when(digit, F.filter(_cards(text), lambda x: _card(x["text"]))).otherwise(none),
        F.when(text.contains("+"), F.filter(find_all(text, PHONE), lambda x: F.char_length(_digits(x["text"])).between(9, 15))).otherwise(none),
    ]
    return F.flatten(F.array(*(_named(spans, k) for k, spans in enumerate(found))))


def _named(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), (x["start"] + F.char_length(x["text"])).alias("end"), x["text"].alias("text")))


def candidates(text: Column, base: Column) -> Column:
    """array<struct<start, kind, end, text, before, after>> of what the labelers judge: what overlaps no base span."""
    none = F.array().cast("array<struct<start: int, text: string, before: string, after: string>>")
    digit = text.rlike("[0-9]")
    found = {SECRET_KIND: (SECRET, digit), LOCAL_KIND: (LOCAL_PHONE, digit), PERSON_KIND: (PERSON, text.rlike(r"\p{Lu}")), ACCOUNT_KIND: (ACCOUNT, digit)}
    def of(kind: int, pattern: str, worth: Column) -> Column:
        hits = F.when(worth, find_all(text, pattern, True)).otherwise(none)
        return F.transform(hits, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), (x["start"] + F.char_length(x["text"])).alias("end"), x["text"].alias("text"), x["before"].alias("before"), x["after"].alias("after")))

    spans = [of(kind, pattern, worth) for kind, (pattern, worth) in found.items()]
    return F.filter(F.concat(*spans), lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))


def _words(before: Column, names: list[str]) -> Column:
    return F.lower(before).rlike(r"\b(?:" + "|".join(names) + r")\b")


def _near(before: Column, names: list[str]) -> Column:
    """One of the words stands just before."""
    return F.lower(before).rlike(r"\b(?:" + "|".join(names) + r")[ :,.]{1,3}$")


def _iban(t: Column) -> Column:
    """The check digits of an IBAN are right: as a number, letters as 10 to 35, first four last, it is 1 modulo 97."""
    plain = F.replace(t, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), lambda acc, c: (F.when(value(c) > 9, acc * 100).otherwise(acc * 10) + value(c)) % 97) == 1


def votes(c: Column) -> Column:
    """Five votes of 1 (yes), -1 (no) or 0 (nothing) on a candidate, by the labelers of its kind."""
    t, before, after = c["text"], c["before"], c["after"]
    letters, digits = F.char_length(F.regexp_replace(t, "[^A-Za-z]", "")), F.char_length(_digits(t))
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    first = F.substring_index(t, " ", 1)
    iban = t.rlike("^[A-Z]{2}[0-9]{2}.{11,}")
    labelers = {
        SECRET_KIND: [
            vote(t.rlike("^(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64}|(?:AKIA|ghp_|sk-)[0-9A-Za-z_-]{12,})$"), t.rlike("^[A-Za-z]+[0-9]{1,2}$|[_-]{2}")),
            vote(_words(before, SECRET_WORDS), _words(before, ["isbn", "doi", "version", "commit", "sha", "file"])),
            vote(before.rlike("[=:]\\s*[\"']?$"), before.rlike("[/#.]$")),
            vote((digits >= 4) & (letters >= 4), (digits < 2) | (letters < 2)),
            vote(before.rlike("[\"']$") & after.rlike("^[\"']"), after.rlike("^[/@.][A-Za-z]")),
        ],
        LOCAL_KIND: [
            vote(t.rlike(r"^\([0-9]{3}\)|^[2-9][0-9]{2}[.-]"), t.rlike("^0{3}|0{4}$")),
            vote(_words(before, PHONE_WORDS), _words(before, NUMBER_WORDS)),
            vote(before.rlike(":\\s*$"), before.rlike("[/#.]$")),
            vote(t.rlike(r"^\(?[2-9][0-9]{2}\D+[2-9]"), t.rlike(r"^\(?[01]")),
            vote(after.rlike("^[.,;]?(?:\\s|$)"), after.rlike("^[/@.%][A-Za-z0-9]")),
        ],
        PERSON_KIND: [
            vote(before.rlike(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Sir|Herr|Frau|Mme|Sra?)\.? $"), _near(before, PLACE_WORDS)),
            vote(first.isin(*GIVEN), F.exists(F.split(t, " "), lambda w: w.isin(*NOT_NAMES))),
            vote(_words(before, NAME_WORDS), before.rlike("(?:^|[.!?\\n])\\s*$")),
            vote(after.rlike(r"^(?:,? (?:born|aged|lives|wrote|said|says|joined|who)\b| ?[<(]|, [0-9]{2}\b)"), after.rlike(r"^ (?:street|st|avenue|road|inc|ltd|gmbh|was built|opens|university|company)\b")),
            vote(t.rlike(r" \p{Lu}\. |^\p{Lu}\p{Ll}+ \p{Lu}\p{Ll}{3,}$"), F.size(F.split(t, " ")) > 3),
        ],
        ACCOUNT_KIND: [
            vote(F.when(iban, _iban(t)).otherwise(t.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")), iban | t.rlike("^(?:19|20)[0-9]{2}(?:0[1-9]|1[0-2])(?:[0-2][0-9]|3[01])$")),
            vote(_words(before, ACCOUNT_WORDS), _words(before, NUMBER_WORDS)),
            vote(F.lower(before).rlike(r"(?::|\bno\.?|\bnr\.?|number|is)\s*$"), before.rlike("[#/$€=]\\s*$")),
            vote(iban | t.rlike("-"), t.rlike("^[0-9]+0{4,}$")),
            vote(after.rlike("^[.,;]?(?:\\s|$)") & before.rlike("\\s$"), after.rlike(r"^(?: ?(?:%|km|kg|ms|usd|eur|bytes|px|times|items)|[/.]\S)")),
        ],
    }
    out = F.array(*(F.lit(0) for _ in range(LABELERS)))
    for kind, own in labelers.items():
        out = F.when(c["kind"] == kind, F.array(*own)).otherwise(out)
    return out


@dataclass
class Classifier:
    """Logistic weights by kind over [1, a column for each yes and no of each labeler, length / 32]."""

    weights: dict = field(default_factory=dict)


def _features(pattern: list[int], size: float) -> list[float]:
    return [1.0, *(float(v == s) for v in pattern for s in (1, -1)), size]


def expectation_maximisation(rows: list[tuple[list[int], float]], rounds: int = 40) -> list[float]:
    """P(yes) of each vote pattern: two classes, each labeler's chance of each vote under each (Dawid and Skene)."""
    post = [1 / (1 + math.exp(-(1.5 * sum(p) - 1.0))) for p, _ in rows]
    for _ in range(rounds):
        total = sum(n for _, n in rows) + 2
        prior = (sum(q * n for q, (_, n) in zip(post, rows, strict=True)) + 1) / total
        chance = []
        for k in range(LABELERS):
            by_class = []
            for side in (1, 0):
                mass = {v: 0.5 + (1.0 if v == (1 if side else -1) else 0.0) for v in (-1, 0, 1)}
                for q, (p, n) in zip(post, rows, strict=True):
                    mass[p[k]] += n * (q if side else 1 - q)
                whole = sum(mass.values())
                by_class.append({v: m / whole for v, m in mass.items()})
            chance.append(by_class)
        post = []
        for p, _ in rows:
            odds = math.log(prior / (1 - prior)) + sum(math.log(chance[k][0][v] / chance[k][1][v]) for k, v in enumerate(p))
            post.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
    return post


def fixed_belief(pattern: list[int] | tuple) -> float:
    """P(yes) of a vote pattern under the fixed reliabilities: three votes of yes without a no are needed for LEAST."""
    odds = math.log(PRIOR / (1 - PRIOR)) + sum(math.log(TRUE_VOTES[v + 1] / FALSE_VOTES[v + 1]) for v in pattern)
    return 1 / (1 + math.exp(-odds))


def fixed_weights() -> list[float]:
    """The classifier that gives fixed_belief, whose log odds are linear in the votes."""
    no, nothing, yes = (math.log(t / f) for t, f in zip(TRUE_VOTES, FALSE_VOTES, strict=True))
    return [math.log(PRIOR / (1 - PRIOR)) + LABELERS * nothing, *(yes - nothing, no - nothing) * LABELERS, 0.0]


def beliefs(rows: list[tuple[list[int], float]]) -> list[float] | None:
    """P(yes) of each vote pattern, or None where the votes cannot tell labelers apart.

    They can if there are enough patterns, if some candidate gets votes of both kinds, if both classes have a share of
    the candidates, and if most labelers say yes more often to true candidates than to false ones.
    """
    post = expectation_maximisation(rows)
    total = sum(n for _, n in rows) or 1
    disagree = any(1 in p and -1 in p for p, _ in rows)
    yes = sum(n for q, (_, n) in zip(post, rows, strict=True) if q >= LEAST) / total
    no = sum(n for q, (_, n) in zip(post, rows, strict=True) if q <= 1 - LEAST) / total

    def better(k: int) -> bool:
        share = [sum(n * (q if side else 1 - q) for q, (p, n) in zip(post, rows, strict=True) if p[k] == 1) / (sum(n * (q if side else 1 - q) for q, (_, n) in zip(post, rows, strict=True)) + 1e-9) for side in (1, 0)]
        return share[0] > share[1]

    if len(rows) >= PATTERNS and disagree and min(yes, no) >= CLASS_SHARE and sum(map(better, range(LABELERS))) > LABELERS // 2:
        return post
    return None


def train(documents: DataFrame, text: str = "text") -> Classifier:
    """Counts the vote patterns of all candidates of all texts, estimates and fits."""
    t = F.coalesce(F.col(text), F.lit(""))
    held = documents.select(t.alias("t"), base_spans(t).alias("base"))
    cands = held.select(F.explode(candidates(F.col("t"), F.col("base"))).alias("c"))
    counted = cands.select(F.col("c.kind").alias("kind"), votes(F.col("c")).alias("v"), F.least(F.round(F.char_length(F.col("c.text")) / 32.0, 1), F.lit(2.0)).alias("size")).groupBy("kind", "v", "size").agg(F.count("*").alias("n")).collect()
    out = Classifier()
    for kind in ADDED:
        mine = sorted((list(r["v"]), float(r["size"]), r["n"]) for r in counted if r["kind"] == kind)
        patterns: dict = {}
        for v, _, n in mine:
            patterns[tuple(v)] = patterns.get(tuple(v), 0) + n
        rows = [(list(v), float(n)) for v, n in sorted(patterns.items())]
        believed = beliefs(rows)
        if mine and believed is None:
            out.weights[kind] = fixed_weights()
            continue
        post = dict(zip((tuple(v) for v, _ in rows), believed or [], strict=True))
        w = [0.0] * (2 + 2 * LABELERS)
        total = sum(n for *_, n in mine) or 1
        for _ in range(300 if mine else 0):
            g = [1e-3 * x for x in w]
            for v, size, n in mine:
                f = _features(v, size)
                p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, f, strict=True))))
                for k, x in enumerate(f):
                    g[k] += (p - post[tuple(v)]) * x * n / total
            w = [a - 1.0 * b for a, b in zip(w, g, strict=True)]
        out.weights[kind] = w if mine else [-9.0] + w[1:]
    return out


def probability(c: Column, model: Classifier) -> Column:
    v = votes(c)
    size = F.least(F.round(F.char_length(c["text"]) / 32.0, 1), F.lit(2.0))

    def linear(w):
        terms = F.aggregate(F.zip_with(v, F.array(*(F.struct(F.lit(w[1 + 2 * k]).alias("yes"), F.lit(w[2 + 2 * k]).alias("no")) for k in range(LABELERS))), lambda a, b: F.when(a == 1, b["yes"]).when(a == -1, b["no"]).otherwise(0.0)), F.lit(0.0), lambda a, b: a + b)
        return F.lit(w[0]) + terms + size * w[-1]

    odds = F.lit(-30.0)
    for kind in ADDED:
        odds = F.when(c["kind"] == kind, linear(model.weights[kind])).otherwise(odds)
    return 1 / (1 + F.exp(-odds))


def with_spans(documents: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """documents with base and spans (base and added), arrays of struct<start, kind, end, text>."""
    t = F.coalesce(F.col(text), F.lit(""))
    kept = documents.drop("base", "spans")
    first = kept.withColumn("base", F.array_sort(base_spans(t))).withColumn("_cands", candidates(t, F.col("base")))
    clear = F.filter("_cands", lambda c: probability(c, model) >= LEAST)
    second = first.withColumn("_cands", F.transform(clear, lambda c: F.struct(*(c[k].alias(k) for k in ("start", "kind", "end", "text")))))
    added = F.filter("_cands", lambda c: ~F.exists("_cands", lambda d: (d["kind"] < c["kind"]) & (d["start"] < c["end"]) & (c["start"] < d["end"])))
    return second.withColumn("spans", F.array_sort(F.concat("base", added))).drop("_cands")


def span_list(spans: Column) -> Column:
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat(F.element_at(kinds, s["kind"] + 1), F.lit(":"), s["start"], F.lit(":"), s["end"])), ",")


def masked(text: Column, spans: Column) -> Column:
    """text with each span replaced by its kind in brackets; where spans overlap, the union by the first's kind."""
    kinds = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    walked = F.aggregate(
        spans,
        empty,
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.element_at(kinds, s["kind"] + 1)))).otherwise(acc["out"]).alias("out"),
        ),
    )
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(walked["out"], ""), F.substring(text, walked["at"] + 1, F.char_length(text))))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_spans(docs, train(docs)).select("doc_id", "base", "spans")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    base, added = ([count(k) for k in kinds] for kinds in (range(4), ADDED))
    return found.select("doc_id", *base, F.sha2(span_list(F.col("base")).cast("binary"), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans"), *added, F.size("spans").cast("long").alias("n_spans"))
