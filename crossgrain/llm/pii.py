"""Personal data: high-recall generators, gradient-boosted trees and calibrated thresholds, in SQL functions only.

Base rules find e-mail addresses, IPv4 addresses, payment cards and phone numbers with a plus. Beyond them,
generators propose spans that the rules miss (written-out or bracketed addresses, national phone numbers,
grouped or mistyped card numbers, spaced or bracketed IPs, and secrets: long strings such as keys, tokens and passwords).
Proposals of one place overlap. Each is described by its format and its neighbourhood, boosted trees score it, and it is
redacted if the score reaches its kind's threshold and no overlapping proposal that does so scores higher.

The trees are trained on the driver on a fixed, generated set of labelled proposals (TRAIN_ROWS); their features
come from the same expressions that describe proposals in documents. Thresholds are the lowest scores whose
precision on a part held out from training reaches PRECISION. Scoring is a sum of CASE expressions.
"""

from __future__ import annotations

import json
import random
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality_rules import fence

KINDS = ("email", "ip", "card", "phone")
#: Kinds of added spans: those of the base rules, and one of their own.
ALL = (*KINDS, "secret")
#: Possessive forms of the rules' patterns, which match the same strings without backtracking. An e-mail's first
#: part may start only where no longer one would: at the text's or last match's end, or after another character; an
#: address's first number only after another character than a digit, since what follows its digits is the same for all of them.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap sign that a text may hold a match.
SIGN = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
#: Of each kind (sign, patterns); the signs are necessary for any of the patterns.
_AT = r"\x20?(?:[\[({]\x20?(?:at|AT|@)\x20?[\])}]|\x20(?:at|AT)\x20|＠)\x20?"
_DOT = r"(?:\x20?[\[({]\x20?(?:dot|DOT|\.)\x20?[\])}]\x20?|\x20(?:dot|DOT)\x20|\.)"
GENERATORS = {
    "email": (
        r"[\[({]\x20?(?:at|AT|@)|\x20(?:at|AT)\x20|＠",
        (rf"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]{{1,64}}+{_AT}[A-Za-z0-9-]{{1,63}}+(?:{_DOT}[A-Za-z0-9-]{{1,63}}+){{1,4}}+",),
    ),
    "ip": (r"[0-9]\x20?[\[(.]", (r"(?<![0-9.])[0-9]{1,3}+(?:\x20?(?:\[\.\]|\(\.\)|\[dot\]|\x20\.\x20?|\.\x20)\x20?[0-9]{1,3}+){3}+(?![0-9])",)),
    "card": (
        r"[0-9]{4}",
        (
            r"(?<![0-9A-Za-z.])[0-9]{4}+(?:[\x20./_-]{0,2}+[0-9]{4}+){2}+[\x20./_-]{0,2}+[0-9]{1,7}+(?![0-9A-Za-z])",
            r"(?<![0-9A-Za-z.])[0-9]{13,19}+(?![0-9A-Za-z])",
        ),
    ),
    "phone": (
        r"[0-9]{3}",
        (r"(?<![0-9A-Za-z+.])(?:00[0-9]{1,3}+[\x20.-]?)?+\(?[0-9]{2,4}+\)?[\x20./-]{1,2}+[0-9]{3,4}+[\x20./-][0-9]{3,4}+(?![0-9A-Za-z])",),
    ),
    "secret": (
        r"[A-Za-z0-9+/_-]{16}|[=:]\x20?[\"'][^\"'\x20]{6}",
        (
            r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]{0,64}[0-9])[A-Za-z0-9+/_-]{16,256}+={0,2}+(?![A-Za-z0-9+/_-])",
            r"(?<=[=:]\x20?[\"'])[^\"'\x20]{6,256}+(?=[\"'])",
        ),
    ),
}
NEAR = 24
#: Words nearby that speak for a kind, or against personal data.
CUES = {
    "email": r"mail|contact|write|reach|kontakt|correo|courriel",
    "ip": r"\bip\b|host|server|address|login|client|ping|adresse",
    "card": r"card|visa|master|credit|debit|payment|karte|tarjeta|carte",
    "phone": r"phone|tel|call|fax|mobile|cell|dial|whatsapp|telefon|tél|llam",
    "secret": r"token|secret|passw|\bpwd\b|api.?key|bearer|credential|\bkey\b|auth|kennwort|clave",
    "against": r"order|invoice|isbn|version|section|part|serial|ticket|ref|build|rev|no\.|nr\.|#|\$|€|id\b|item|page|model|lot|commit|sha|hash|checksum|digest|url|href|path|file",
}
TRAIN_ROWS, TREES, DEPTH, RATE, PRECISION = 4000, 30, 3, 0.3, 0.98

#: Matches whose places are summed at once.
CHUNK = 256
SPAN = "array<struct<s:int,e:int,t:string>>"


def found(text: Column, pattern: str, sign: str) -> Column:
    """All matches as structs (s, e, t): start and end in code points, and the string.

    Starts are sums of the lengths ahead, taken chunk by chunk, so that work doesn't grow with the square of the matches.
    """
    gaps = F.split(text, pattern, -1)
    both = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), gaps, lambda t, g: F.struct(t.alias("t"), F.length(g).alias("g")))

    def chunk_spans(chunk: Column) -> Column:
        """Spans that count from the chunk's start, and its length."""
        start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

        def step(acc: Column, x: Column) -> Column:
            s = acc["at"] + x["g"]
            e = s + F.coalesce(F.length(x["t"]), F.lit(0))
            span = F.struct(s.alias("s"), e.alias("e"), x["t"].alias("t"))
            return F.struct(e.alias("at"), F.when(x["t"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], span)).alias("out"))

        return F.aggregate(chunk, start, step)

    def spans(every: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(every) - 1) / CHUNK).cast("int")), lambda k: chunk_spans(F.slice(every, k * CHUNK + 1, CHUNK)))
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        add = lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
        moved = lambda x, by: F.transform(x["out"], lambda y: F.struct((y["s"] + by).alias("s"), (y["e"] + by).alias("e"), y["t"].alias("t")))
        return F.flatten(bound(chunks, lambda c: F.zip_with(c, F.aggregate(c, first, add, lambda acc: acc["out"]), moved)))

    return F.when(text.rlike(sign), bound(both, spans)).otherwise(F.array().cast(SPAN))


def bound(value: Column, f) -> Column:
    """f(value), with value made once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def valid(kind: str, t: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.ltrim(p, F.lit("0"))
        small = lambda p: (F.length(part(p)) <= 2) | ((F.length(part(p)) == 3) & (part(p) <= "255"))
        return F.forall(F.split(t, r"\."), small)
    if kind == "card":
        return F.length(digits(t)).between(13, 19) & F.call_function("luhn_check", digits(t))
    if kind == "phone":
        return F.length(digits(t)).between(9, 15)
    return F.lit(True)


def describe(kind: Column, t: Column, left: Column, right: Column) -> list[Column]:
    """Features of a proposal: its format, then its neighbourhood (NEAR characters on each side)."""
    flag = lambda c: F.coalesce(c.cast("int"), F.lit(0)).cast("double")
    near = F.lower(F.concat(left, F.lit(" "), right))
    d = digits(t)
    out = [flag(kind == k) for k in ALL]
    out += [
        F.length(d).cast("double"),
        F.length(t).cast("double"),
        flag(F.call_function("luhn_check", d)),
        F.regexp_count(t, F.lit("[0-9]+")).cast("double"),
        flag(t.contains("(")),
        flag(t.rlike(r"[\[({]\x20?(at|AT|@|dot|DOT|\.)")),
        F.regexp_count(t, F.lit(r"\b(at|AT|dot|DOT)\b")).cast("double"),
        flag(t.rlike(r"^[3-6]")),
        flag(t.rlike(r"^\(?0|^\([2-9][0-9]{2}\)|^[2-9][0-9]{2}[ .-][2-9][0-9]{2}[ .-][0-9]{4}$")),
        flag(t.rlike(r"^(19|20)[0-9]{2}\b|^[0-3]?[0-9][./-]")),
        flag(t.rlike(r"^([0-9])\1*$|0123|1234|0000")),
        flag(left.rlike(r"[A-Za-z0-9#$€_/=.,-]$")),
        flag(right.rlike(r"^[A-Za-z0-9%_/=-]|^[.,][0-9]")),
        flag(t.rlike(r"(com|org|net|edu|de|fr|es|io|gov)$")),
        flag(t.rlike("[A-Za-z]") & t.rlike("[0-9]")),
        flag(t.rlike("^[0-9A-Fa-f]+$")),
        F.size(F.array_distinct(F.split(t, ""))).cast("double"),
        flag(left.rlike(r"[=:]\x20?[\"']?$")),
        flag(F.forall(F.regexp_extract_all(t, F.lit("[0-9]+"), F.lit(0)), lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))),
    ]
    out += [flag(near.rlike(p)) for p in CUES.values()]
    return out


#: How many features describe() gives.
FEATURES = len(ALL) + 19 + len(CUES)


def examples(n: int = TRAIN_ROWS, seed: int = 11) -> list[tuple[str, str, str, str, int]]:
    """Labelled proposals (kind, string, left, right, label), made by rule; the fixed training set."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(["an", "the", "or", "in", "es", "ti", "de", "ou"]) for _ in range(r.randint(1, 4)))
    cue = {
        "email": ["e-mail me: ", "contact ", "write to ", "mail "],
        "ip": ["ip ", "host ", "server ", "login from "],
        "card": ["card ", "visa ", "credit card no ", "payment by "],
        "phone": ["tel. ", "phone: ", "call ", "fax ", "mobile "],
        "secret": ['token = "', "api_key: ", 'password = "', "secret=", 'TOKEN = "', "Authorization: Bearer ", "key = '", 'pwd: "'],
    }
    mixed = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    against = ["order ", "invoice #", "isbn ", "version ", "serial ", "ticket ", "ref ", "part no. ", "item ", "section ", "$", "build "]

    def luhn(k: int) -> str:
        body = r.choice("3456") + num(k - 2)
        total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(body)))
        return body + str(-total % 10)

    def good(kind: str) -> str:
        if kind == "email":
            at, dot = r.choice([(" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "."), (" {at} ", "."), ("[at]", "[dot]"), (" AT ", " DOT ")])
            return f"{word()}.{word()}{at}{word()}{dot}{r.choice(['com', 'org', 'net', 'de', 'fr'])}"
        if kind == "ip":
            return r.choice(["[.]", " . ", "(.)", "[dot]"]).join(str(r.randint(1, 255)) for _ in range(4))
        if kind == "card":
            c = luhn(16)
            return r.choice([".", "/", "_", "  ", " - "[:2]]).join(c[k : k + 4] for k in range(0, 16, 4))
        if kind == "secret":
            k = r.choice([16, 20, 24, 32, 40, 64])
            return r.choice(["".join(r.choice("0123456789abcdef") for _ in range(k)), "".join(r.choice(mixed) for _ in range(k)), "".join(r.choice("0123456789ABCDEF") for _ in range(k))])
        return r.choice([f"({r.randint(200, 989)}) {r.randint(200, 999)}-{num(4)}", f"{r.randint(200, 989)}-{r.randint(200, 999)}-{num(4)}", f"0{num(2)} {num(3)} {num(4)}", f"{r.randint(200, 989)}.{r.randint(200, 999)}.{num(4)}", f"0049 {num(3)} {num(4)} {num(4)}"])

    def bad(kind: str) -> str:
        if kind == "email":
            return r.choice([f"{word()} at {word()}.{word()}", f"{word()} at {word()} dot {word()}", f"meet {word()} at noon.{word()}"])
        if kind == "ip":
            return r.choice([". ", " . "]).join(num(r.randint(1, 3)) for _ in range(4))
        if kind == "card":
            return r.choice(["", "-", " ", ".", "/"]).join([num(4), num(4), num(4), num(r.randint(1, 7))])
        if kind == "secret":
            k = r.choice([20, 32, 40, 64])
            path = "/".join([word(), word(), num(4), word()])
            return r.choice(["".join(r.choice("0123456789abcdef") for _ in range(k)), num(k), f"{word()}-{word()}-{num(2)}-{word()}{word()}", path, f"{word()}_{word()}_{word()}{num(1)}_{word()}", "-" * 20 + "0", word() + word() + num(3)])
        return r.choice([f"{r.randint(1900, 2030)}-{num(3)}-{num(3)}", f"{num(3)} {num(3)} {num(3)}", f"{num(2)}.{num(3)}.{num(3)}", f"{num(2)}-{num(4)}-{num(4)}", f"{num(4)} {num(4)} {num(4)}"])

    def around(text: str) -> str:
        """As texts come: in capitals, with signs after words, or as they are."""
        style = r.random()
        return text.upper() if style < 0.1 else text.replace(" ", r.choice(["*** ", "!! ", " | "])) if style < 0.2 else text

    rows = []
    for k in range(n):
        kind, label = ALL[k % len(ALL)], r.randint(0, 1)
        plain = around(f"{word()} {word()} ")
        if kind == "secret":  # what it is shows by what stands ahead
            left = plain + (r.choice(cue[kind]) if label else r.choice(["", "", "commit ", "sha256:", "/", "file ", 'href="', "id=", "checksum "]))
        else:
            left = r.choice([plain, plain + r.choice(cue[kind])] if label else [plain, plain, plain + r.choice(against), plain + r.choice(against) + "no. "])
        right = around(f" {word()} {word()}.")
        right = left[-1] + right if left[-1] in "\"'" else right
        rows.append((kind, good(kind) if label else bad(kind), left[-NEAR:], right[:NEAR], label))
    return rows


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> tuple | float:
    """A regression tree (feature, cut, below, above) by second-order gain; a leaf is its step."""
    leaf = float(-g.sum() / (h.sum() + 1.0))
    if depth == 0 or len(g) < 20:
        return leaf
    best, base = (1e-6, None, None), g.sum() ** 2 / (h.sum() + 1.0)
    for j in range(x.shape[1]):
        for cut in np.unique(x[:, j])[:-1][:40]:
            m = x[:, j] <= cut
            gain = g[m].sum() ** 2 / (h[m].sum() + 1) + g[~m].sum() ** 2 / (h[~m].sum() + 1) - base
            if gain > best[0] and min(m.sum(), (~m).sum()) >= 8:
                best = (gain, j, float(cut))
    if best[1] is None:
        return leaf
    m = x[:, best[1]] <= best[2]
    return (best[1], best[2], grow(x[m], g[m], h[m], depth - 1), grow(x[~m], g[~m], h[~m], depth - 1))


def apply_tree(tree: tuple | float, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    return np.where(x[:, tree[0]] <= tree[1], apply_tree(tree[2], x), apply_tree(tree[3], x))


def tree_column(tree: tuple | float, x: list[Column]) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(tree)
    return F.when(x[tree[0]] <= tree[1], tree_column(tree[2], x)).otherwise(tree_column(tree[3], x))


def boost(x: np.ndarray, y: np.ndarray) -> list:
    score, trees = np.zeros(len(y)), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        tree = grow(x, p - y, p * (1 - p), DEPTH)
        trees.append(tree)
        score += RATE * apply_tree(tree, x)
    return trees


def thresholds(score: np.ndarray, y: np.ndarray, kind: np.ndarray) -> dict[str, float]:
    """For each kind the lowest score from which on precision reaches PRECISION; infinite if none does."""
    out = {}
    for k in ALL:
        s, t = score[kind == k], y[kind == k]
        order = np.argsort(-s, kind="stable")
        s, precision = s[order], np.cumsum(t[order]) / np.arange(1, len(t) + 1)
        ends = np.append(s[1:] != s[:-1], True) if len(s) else np.zeros(0, bool)
        ok = np.flatnonzero((precision >= PRECISION) & ends)
        out[k] = float(s[ok[-1]]) if len(ok) else float("inf")
    return out


@cache
def _model() -> dict:
    return {}


def model(spark: SparkSession) -> tuple[list, dict[str, float]]:
    """(trees, thresholds), trained once a session on the fixed set; every third row sets the thresholds."""
    kept = _model()
    if "trees" not in kept:
        rows = examples()
        text = json.dumps([dict(zip(("n", "kind", "t", "l", "r"), (k, *x[:4]), strict=True)) for k, x in enumerate(rows)])
        df = spark.range(1).select(F.explode(F.from_json(F.lit(text), "array<struct<n:int,kind:string,t:string,l:string,r:string>>")).alias("x"))
        df = df.select("x.*")
        df = df.select("n", F.array(*describe(F.col("kind"), F.col("t"), F.col("l"), F.col("r"))).alias("f"))
        x = np.array([r["f"] for r in df.orderBy("n").collect()])
        y, kind = np.array([x[4] for x in rows], float), np.array([x[0] for x in rows])
        held = np.arange(len(y)) // len(ALL) % 3 == 2
        trees = boost(x[~held], y[~held])
        score = sum(RATE * apply_tree(t, x[held]) for t in trees)
        kept["thresholds"], kept["trees"] = thresholds(score, y[held], kind[held]), trees
    return kept["trees"], kept["thresholds"]


def find_spans(docs: DataFrame) -> DataFrame:
    """docs with text (null: empty), base and added: arrays of spans (k, s, e), sorted; k indexes ALL. Other columns
    of docs must not be named like those that are made here.

    Added spans never overlap base ones; of overlapping proposals that pass the one with the highest score stays, then the
    first, then the longest, then that of the first kind.
    """
    trees, least = model(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.withColumn("text", text)

    def by_rule(k: int, kind: str) -> Column:
        spans = F.filter(found(F.col("text"), BASE[kind], SIGN[kind]), lambda x: valid(kind, x["t"]))
        return F.transform(spans, lambda x: F.struct(F.lit(k).alias("k"), x["s"].alias("s"), x["e"].alias("e")))

    def by_generator(k: int, pattern: str, sign: str) -> Column:
        spans = found(F.col("text"), pattern, sign)
        return F.transform(spans, lambda x: F.struct(F.lit(k).alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["t"].alias("t")))

    df = fence(df, "base", F.sort_array(F.concat(*[by_rule(k, kind) for k, kind in enumerate(KINDS)])))
    proposals = [by_generator(k, pattern, GENERATORS[kind][0]) for k, kind in enumerate(ALL) for pattern in GENERATORS[kind][1]]
    df = fence(df, "proposed", F.array_distinct(F.concat(*proposals)))
    overlap = lambda x, y: (y["s"] < x["e"]) & (x["s"] < y["e"])
    df = fence(df, "proposed", F.filter("proposed", lambda x: ~F.exists("base", lambda b: overlap(x, b))))

    def described(x: Column) -> Column:
        kind = F.element_at(F.array(*[F.lit(k) for k in ALL]), x["k"] + 1)
        left = F.substring(F.col("text"), F.greatest(x["s"] - NEAR, F.lit(0)) + 1, F.least(x["s"], F.lit(NEAR)))
        right = F.substring(F.col("text"), x["e"] + 1, F.lit(NEAR))
        return F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"), F.array(*describe(kind, x["t"], left, right)).alias("f"))

    df = fence(df, "described", F.transform("proposed", described))

    def scored(x: Column) -> Column:
        f = [F.get(x["f"], j) for j in range(FEATURES)]
        score = F.lit(0.0)
        for tree in trees:
            score = score + F.lit(RATE) * tree_column(tree, f)
        wanted = F.element_at(F.array(*[F.lit(least[k]) for k in ALL]), x["k"] + 1)
        rank = F.struct(score.alias("score"), (-x["s"]).alias("s"), x["e"].alias("e"), (-x["k"]).alias("k"))
        return F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"), rank.alias("rank"), (score >= wanted).alias("passes"))

    df = fence(df, "passed", F.filter(F.transform("described", scored), lambda x: x["passes"]))
    best = F.filter("passed", lambda x: ~F.exists("passed", lambda y: overlap(x, y) & (y["rank"] > x["rank"])))
    kept = F.transform(best, lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e")))
    return fence(df, "added", F.sort_array(kept)).drop("proposed", "described", "passed")


def joined(spans: Column) -> Column:
    kind = lambda k: F.element_at(F.array(*[F.lit(x) for x in ALL]), k + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kind(x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans). Null or empty text: no spans."""
    df = find_spans(docs.select("doc_id", "text"))
    df = fence(df, "names", joined(F.col("base")))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == F.lit(k))).cast("long")
    return df.select(
        F.col("doc_id").cast("long"),
        *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.sha2(F.col("names").cast("binary"), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """docs with every found span in text replaced by its kind in brackets; overlapping spans by the first one's.

    Null texts stay null. n_chars, where there is such a column, is set anew.
    """
    carried = {c: f"_in{k}" for k, c in enumerate(docs.columns)}
    df = find_spans(docs.select("text", *[F.col(c).alias(name) for c, name in carried.items()]))
    names = F.array(*[F.lit(f"<{k}>") for k in ALL])
    by_start = F.array_sort(F.transform(F.concat("base", "added"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"))))
    df = fence(df, "_spans", by_start)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(F.col("text"), acc["at"] + 1, x["s"] - acc["at"])
        return F.when(x["s"] < acc["at"], F.struct(F.greatest(acc["at"], x["e"]).alias("at"), acc["out"].alias("out"))).otherwise(
            F.struct(x["e"].alias("at"), F.concat(acc["out"], gap, F.element_at(names, x["k"] + 1)).alias("out"))
        )

    clean = F.aggregate("_spans", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length(F.col("text")))))
    df = fence(df, "_clean", F.when(F.size("_spans") > 0, clean).otherwise(F.col(carried["text"]).cast("string")))
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("_clean").alias(c))
        elif c == "n_chars":
            columns.append(F.length("_clean").cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col(carried[c]).alias(c))
    return df.select(*columns)
