"""Personal data spans: fixed base patterns, and a boosted-tree judge over high-recall candidates.

Everything that touches documents is DataFrame functions. Matches get their places from the texts between them:
a split by the same pattern gives the gaps, and running lengths give code point offsets. Patterns are written so that
each position is tried once (run starts and \\G instead of every character of a run; possessive repeats), which
keeps very long runs linear and Java's matcher off the stack.

Candidates come from wide patterns and may overlap. Their format (lengths, digits, groups, check digit) and context (cue
words before, characters around) are features of gradient-boosted trees, trained here on generated labelled examples,
and a threshold for each kind, set on examples held out from training for a stated precision, decides. Candidates that overlap a base span
go; of those that overlap each other the set with the largest sum of margins over the thresholds stays. All of it is linear in the
number of spans.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]

#: The base patterns, in a form that finds the same leftmost matches in one pass.
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A cheap condition that a text must meet before a pattern is run on it.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}

WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[({] ?(?:at|AT|@) ?[\])}] ?[A-Za-z0-9-]++(?:(?: ?[\[({] ?(?:dot|DOT|\.) ?[\])}] ?|\.)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}+:){7}+[0-9A-Fa-f]{1,4}+(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])(?<![0-9][ .-])[0-9](?:[ .-]?[0-9]){12,18}+(?![ .-]?[0-9])",
    "phone": r"(?<![0-9A-Za-z+.-])(?:00[1-9][0-9]{0,2}+[ .-])?+\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])",
    "secret": r"(?i)(?<![A-Za-z])(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)[\"']?+ ?[:=] ?[\"']?[A-Za-z0-9+/_=-]{12,}+",
}
WIDE_NEEDS = {"email": r"[\[({] ?(?:at|AT|@) ?[\])}]", "ip": r":[0-9A-Fa-f]{1,4}:", "card": r"[0-9]", "phone": r"[0-9]{3}[ .-][0-9]{4}", "secret": r"(?i)(?:token|secret|passw|key)[\"']? ?[:=]"}
CUES = {
    "email": r"(?i)(?:mail|contact|write|reach)", "ip": r"(?i)(?:\bip\b|host|server|address|ipv6)", "card": r"(?i)(?:card|visa|amex|credit|payment)",
    "phone": r"(?i)(?:tel|phone|call|mobile|fax|text)", "secret": r"(?i)(?:export|config|auth|login|env)",
}
DECOYS = r"(?i)(?:order|invoice|isbn|version|part|serial|ticket|sample|example|placeholder|hash|checksum|score)"
FEATURES = ("kind", "length", "digits", "letters", "marks", "groups", "luhn", "distinct", "cue", "decoy", "before", "after", "hex", "upper", "repeats")

ROUNDS, DEPTH, RATE, EXAMPLES, PRECISION = 40, 3, 0.3, 3000, 0.99


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)
    value = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")
    one = lambda i: F.when(i % 2 == 0, value(i)).otherwise(value(i) * 2 - F.when(value(i) > 4, 9).otherwise(0))
    return (n > 0) & (F.aggregate(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), F.lit(0), lambda a, i: a + F.coalesce(one(i), F.lit(0))) % 10 == 0)


SPANS = "array<struct<kind:int,start:int,stop:int,part:string,before:string,after:string>>"
#: Arrays are walked, and texts cut, in blocks of this size: what is copied grows with it instead of with the whole.
BLOCK, TEXT_BLOCK = 256, 1024


def bound(value: Column, use) -> Column:
    """use(value), with the value computed once, wherever it stands in what is made of it."""
    return F.transform(F.array(value), use)[0]


def scanned(items: Column, zero: Column, step, emit, kind: str) -> Column:
    """emit(state, x) of each item, where the state is what `step` made of the items before it, in linear time."""
    none = F.array().cast(f"array<{kind}>")
    one = lambda acc, x: F.struct(step(acc["state"], x).alias("state"), F.concat(acc["out"], F.array(emit(acc["state"], x))).alias("out"))

    def block(acc, some):
        return F.aggregate(some, F.struct(acc["state"].alias("state"), none.alias("out")), one, lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    def whole(all_):
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / BLOCK).cast("int")), lambda k: F.slice(all_, k * BLOCK + 1, F.lit(BLOCK)))
        start = F.struct(zero.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        return F.when(F.size(all_) > 0, F.aggregate(blocks, start, block, lambda acc: F.flatten(acc["out"]))).otherwise(none)

    return bound(items, whole)


def walked(parts: Column, gaps: Column, kind: str) -> Column:
    """Places of the matches, from the matches and the texts between them."""

    def places(p, g):
        sizes = F.transform(p, lambda x, i: F.struct(F.length(F.get(g, i)).alias("gap"), F.length(x).alias("part")))
        starts = scanned(sizes, F.lit(0), lambda at, x: at + x["gap"] + x["part"], lambda at, x: at + x["gap"], "int")
        span = lambda start, i: F.struct(F.lit(KINDS.index(kind)).alias("kind"), start.alias("start"), (start + F.length(F.get(p, i))).alias("stop"), F.get(p, i).alias("part"), F.right(F.get(g, i), F.lit(24)).alias("before"), F.left(F.get(g, i + 1), F.lit(1)).alias("after"))
        return F.transform(starts, span)

    none = F.array().cast(SPANS)
    return F.when(F.size(parts) > 0, bound(parts, lambda p: bound(gaps, lambda g: places(p, g)))).otherwise(none)


def apart_from(candidates: Column, fixed: Column) -> Column:
    """The candidates that overlap none of the fixed spans, by two walks over both in order of start."""
    rows = F.array_sort(F.concat(
        F.transform(fixed, lambda b: F.struct(b["start"].alias("start"), F.lit(-1).alias("at"), b["stop"].alias("stop"))),
        F.transform(candidates, lambda c, i: F.struct(c["start"].alias("start"), i.alias("at"), c["stop"].alias("stop"))),
    ))

    def clear(u):
        # An earlier fixed span that ends after the start, or a later one that starts before the end.
        early = scanned(u, F.lit(0), lambda end, x: F.when(x["at"] < 0, F.greatest(end, x["stop"])).otherwise(end), lambda end, x: end > x["start"], "boolean")
        late = F.reverse(scanned(F.reverse(u), F.lit((1 << 31) - 1), lambda start, x: F.when(x["at"] < 0, x["start"]).otherwise(start), lambda start, x: start < x["stop"], "boolean"))
        free = bound(early, lambda e: bound(late, lambda o: F.filter(u, lambda x, i: (x["at"] >= 0) & ~F.get(e, i) & ~F.get(o, i))))
        return bound(candidates, lambda c: F.transform(free, lambda x: F.get(c, x["at"])))

    return bound(rows, clear)


BEST = "struct<total:double,previous:int>"


def best_apart(judged_: Column) -> Column:
    """The candidates (kind, start, stop, margin) that do not overlap and have the largest sum of margins, by one walk to and one fro."""
    rows = F.array_sort(F.transform(judged_, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["stop"].alias("stop"), c["margin"].alias("margin"))))
    rows = F.transform(rows, lambda c, i: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["stop"].alias("stop"), c["margin"].alias("margin"), i.alias("at")))

    def best(state, x):
        """The best sum that ended before a candidate, and the candidate it ended with."""
        over = F.filter(state["open"], lambda o: o["stop"] <= x["start"])
        better = lambda a, o: F.when(o["total"] > a["total"], F.struct(o["total"].alias("total"), o["at"].alias("previous"))).otherwise(a)
        return F.aggregate(over, F.struct(state["total"].alias("total"), state["previous"].alias("previous")), better)

    def step(state, x):
        # At most one candidate of each kind is open, as those of a kind do not overlap.
        still = F.filter(state["open"], lambda o: o["stop"] > x["start"])
        held = lambda b: F.struct(b["total"].alias("total"), b["previous"].alias("previous"), F.concat(still, F.array(F.struct(x["stop"].alias("stop"), (b["total"] + x["margin"]).alias("total"), x["at"].alias("at")))).alias("open"))
        return bound(best(state, x), held)

    emit = lambda state, x: bound(best(state, x), lambda b: F.struct((b["total"] + x["margin"]).alias("total"), b["previous"].alias("previous")))
    zero = F.struct(F.lit(0.0).alias("total"), F.lit(-1).alias("previous"), F.array().cast("array<struct<stop:int,total:double,at:int>>").alias("open"))

    def chosen(u):
        def back(sums):
            last = F.array_max(F.transform(sums, lambda b, i: F.struct(b["total"].alias("total"), (-i).alias("at"))))["at"]
            taken = F.reverse(scanned(F.reverse(u), -last, lambda at, x: F.when(x["at"] == at, F.get(sums, at)["previous"]).otherwise(at), lambda at, x: x["at"] == at, "boolean"))
            return bound(taken, lambda t: F.filter(u, lambda x, i: F.get(t, i)))

        return F.when(F.size(u) > 1, bound(scanned(u, zero, step, emit, BEST), back)).otherwise(u)

    return bound(rows, chosen)


def located(docs: DataFrame, wanted: dict[str, tuple[str, str, Column]]) -> DataFrame:
    """`docs` with a span column for each {name: (kind, pattern, condition on the text)}; each pattern runs once or twice on a text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<string>")
    out = docs.withColumns({f"{n}_parts": F.when(need, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none) for n, (_, pattern, need) in wanted.items()})
    out = out.withColumns({f"{n}_gaps": F.when(F.size(f"{n}_parts") > 0, F.split(text, pattern, -1)).otherwise(none) for n, (_, pattern, _) in wanted.items()})
    return out.withColumns({n: walked(F.col(f"{n}_parts"), F.col(f"{n}_gaps"), kind) for n, (kind, _, _) in wanted.items()}).drop(*[f"{n}_{x}" for n in wanted for x in ("parts", "gaps")])


def _holds(kind: str, part: Column) -> Column:
    """What a base match must meet besides the pattern."""
    digits = F.regexp_replace(part, "[^0-9]", "")
    if kind == "ip":
        bare = lambda p: F.ltrim(p, F.lit("0"))
        value = lambda p: F.when(F.length(bare(p)) <= 3, F.concat(F.lit("0"), bare(p)).cast("int")).otherwise(256)
        return F.forall(F.split(part, r"\."), lambda p: value(p) <= 255)
    if kind == "card":
        return luhn(digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def features(c: Column) -> Column:
    """A candidate's features, in the order of FEATURES."""
    part, count = c["part"], lambda p: F.length(F.regexp_replace(c["part"], p, ""))
    digits = F.regexp_replace(part, "[^0-9]", "")
    by_kind = lambda patterns: F.coalesce(*[F.when(c["kind"] == i, c["before"].rlike(patterns[k])) for i, k in enumerate(KINDS)])
    values = (
        c["kind"], F.length(part), F.length(digits), count("[^A-Za-z]"), count("[A-Za-z0-9]"), F.size(F.split(part, "[^A-Za-z0-9]+")), luhn(digits),
        F.size(F.array_distinct(F.split(part, ""))), by_kind(CUES), c["before"].rlike(DECOYS), c["before"].rlike("[A-Za-z0-9]$"), c["after"].rlike("[A-Za-z0-9]"),
        F.regexp_extract(part, "([A-Za-z0-9+/_=-]+)$", 1).rlike("^[0-9A-Fa-f]+$"), count("[^A-Z]"), F.length(F.regexp_extract(digits, r"(([0-9])\2+)", 1)),
    )
    return F.array(*[v.cast("double") for v in values])


def examples(n: int = EXAMPLES, seed: int = 5) -> list[tuple[int, str, str, str, int]]:
    """Generated candidates: kind, part, text before, character after, label."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda a=3, b=9: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(a, b)))

    def card(good):
        k = r.choice((13, 14, 15, 16, 16, 16, 19))
        body = r.choice("3456") + digits(k - 2)
        check = next(d for d in "0123456789" if sum(v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for i, v in enumerate(map(int, (body + d)[::-1]))) % 10 == 0)
        number = body + (check if good else r.choice([d for d in "0123456789" if d != check]))
        gap = r.choice(("", " ", "-", "."))
        return gap.join(number[i : i + 4] for i in range(0, len(number), 4))

    cue = {0: ("e-mail ", "contact: ", "write to "), 1: ("IPv6 ", "host ", "server "), 2: ("card ", "Visa: ", "payment "), 3: ("tel. ", "phone: ", "call "), 4: ("export ", "config ", "auth ")}
    decoy = ("order ", "invoice no. ", "ISBN ", "version ", "part ", "serial ", "ticket ", "sample ", "checksum ")
    out = []
    for _ in range(n):
        kind, good = r.randrange(5), r.random() < 0.5
        if kind == 0:
            a, d = r.choice((("[at]", "[dot]"), ("(at)", "(dot)"), (" (at) ", "."), ("{at}", "{dot}"), ("[@]", "[.]")))
            part = word() + r.choice(("", ".", "_")) + word() + a + word() + d + (r.choice(("com", "org", "net", "de")) if good else digits(r.randint(1, 4)))
        elif kind == 1:
            part = ":".join("".join(r.choice("0123456789abcdef") for _ in range(r.randint(1, 4))) for _ in range(8)) if good else ":".join(f"{r.randrange(60):02d}" for _ in range(8))
        elif kind == 2:
            part = card(good)
        elif kind == 3:
            a, b, c = digits(3), digits(3), digits(4)
            part = r.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}")) if good else f"{a} {b} {c}"
        else:
            value = "".join(r.choice("0123456789abcdef" if r.random() < 0.6 else "ABCDEFGHabcdefgh0123456789+/_") for _ in range(r.choice((16, 20, 32, 40, 64)))) if good else "-".join(word(4, 8) for _ in range(3))
            part = r.choice(("token", "api_key", "secret", "password")) + r.choice((" = ", ": ", "=", ' = "', ':"')) + value
        before = word() + " " + (r.choice(cue[kind]) if r.random() < (0.45 if good else 0.1) else r.choice(decoy) if not good and r.random() < 0.6 else word() + " ")
        if not good and r.random() < 0.1:
            before = before.strip()
        out.append((kind, part, before[-24:], r.choice((" ", ".", ",", '"', "")), int(good and not (kind == 3 and "(" not in part and "-" not in part and "." not in part and not any(c in before for c in cue[3])))))
    return out


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    """A regression tree on gradients: (feature, threshold, left, right) or a leaf's value."""
    whole = g.sum() ** 2 / (h.sum() + 1)
    best = (1e-3, None)
    if depth:
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for t in (values[:-1] + values[1:]) / 2 if len(values) <= 32 else np.unique(np.quantile(values, np.linspace(0.03, 0.97, 31))):
                left = x[:, f] <= t
                if 0 < left.sum() < len(left):
                    gl, hl = g[left].sum(), h[left].sum()
                    gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - whole
                    if gain > best[0]:
                        best = (gain, (f, float(t), left))
    if best[1] is None:
        return float(g.sum() / (h.sum() + 1))
    f, t, left = best[1]
    return f, t, _grow(x[left], g[left], h[left], depth - 1), _grow(x[~left], g[~left], h[~left], depth - 1)


def _value(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    f, t, a, b = tree
    return np.where(x[:, f] <= t, _value(a, x), _value(b, x))


def fit(x: np.ndarray, y: np.ndarray) -> list:
    trees, score = [], np.zeros(len(y))
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-score))
        tree = _grow(x, y - p, p * (1 - p), DEPTH)
        trees.append(tree)
        score = score + RATE * _value(tree, x)
    return trees


@lru_cache(maxsize=1)
def model() -> tuple[list, tuple[float, ...]]:
    """Trees and each kind's threshold on their sum. Features come from the same expressions that documents meet."""
    spark = SparkSession.getActiveSession()
    shape = "kind int, part string, before string, after string, label int"
    rows = spark.createDataFrame(examples(), shape).select(features(F.struct("kind", "part", "before", "after")).alias("x"), "label").collect()
    x, y = np.array([[v or 0.0 for v in r["x"]] for r in rows]), np.array([r["label"] for r in rows], float)
    held = np.arange(len(y)) % 3 == 0
    trees = fit(x[~held], y[~held])
    score = RATE * sum(_value(t, x[held]) for t in trees)
    limits = []
    for kind in range(len(KINDS)):
        mine = x[held][:, 0] == kind
        s, label = score[mine], y[held][mine]
        order = np.argsort(-s, kind="stable")
        precise = np.cumsum(label[order]) / np.arange(1, len(order) + 1) >= PRECISION
        limits.append(max(0.0, float(s[order][np.nonzero(precise)[0].max()])) if precise.any() else 1e9)
    return trees, tuple(limits)


def _expression(tree, x: Column) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    f, t, a, b = tree
    return F.when(F.get(x, F.lit(f)) <= t, _expression(a, x)).otherwise(_expression(b, x))


def judged(candidates: Column) -> Column:
    """Candidates that pass their kind's threshold, and by what margin."""
    trees, limits = model()
    with_x = F.transform(candidates, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["stop"].alias("stop"), features(c).alias("x")))
    total = lambda x: sum((_expression(t, x) for t in trees[1:]), _expression(trees[0], x)) * RATE
    limit = lambda k: F.get(F.array(*map(F.lit, limits)), k)
    scored = F.transform(with_x, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["stop"].alias("stop"), (total(c["x"]) - limit(c["kind"])).alias("margin")))
    return F.filter(scored, lambda c: c["margin"] >= 0)


def _rendered(spans: Column) -> Column:
    name = lambda k: F.get(F.array(*map(F.lit, KINDS)), k)
    return F.array_join(F.transform(spans, lambda s: F.concat(name(s["kind"]), F.lit(":"), s["start"], F.lit(":"), s["stop"])), ",")


def spans(docs: DataFrame) -> DataFrame:
    """All columns of `docs` with `base` and `added`: arrays of struct(start, kind, stop), in order of start and kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    short = lambda found: F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"))))
    need = lambda k: text.contains(NEEDS[k]) if NEEDS[k] else text.rlike("[0-9][0-9 -]{12}")
    wanted = {f"_base_{k}": (k, BASE[k], need(k)) for k in BASE_KINDS} | {f"_wide_{k}": (k, WIDE[k], text.rlike(WIDE_NEEDS[k])) for k in KINDS}
    out = located(docs, wanted)
    held = lambda k: F.filter(f"_base_{k}", lambda s: _holds(k, s["part"]))
    out = out.withColumns({"_base": F.concat(*[held(k) for k in BASE_KINDS]), "_wide": F.concat(*[f"_wide_{k}" for k in KINDS])})
    out = out.withColumn("_new", F.when(F.size("_wide") > 0, judged(apart_from(F.col("_wide"), F.col("_base")))))
    kept = F.when(F.size("_new") > 0, best_apart(F.col("_new")))
    empty = F.array().cast("array<struct<start:int,kind:int,stop:int>>")
    out = out.withColumns({"base": short(F.col("_base")), "added": F.coalesce(short(kept), empty)})
    return out.select(*[c for c in docs.columns if c not in ("base", "added")], "base", "added")


def report(docs: DataFrame) -> DataFrame:
    """Spans of every document; returns doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    The counts and the digest are of the base spans; `spans` lists base and added ones. A null or empty text has none (the
    digest is then that of the empty string). Each row is judged by itself, so repeated rows give equal results; an empty
    table gives no rows. Other columns are ignored.
    """
    found = spans(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long")
    both = F.array_sort(F.concat("base", "added"))
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE_KINDS], F.sha2(_rendered(F.col("base")), 256).alias("base_sha256"), _rendered(both).alias("spans"), F.size("added").cast("long").alias("n_added"))


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with each span of its texts replaced by its kind in angle brackets; overlapping spans of several kinds become the first's.

    Columns stay as they are, but for `text`, and `n_chars` where there is one. Null texts stay null.
    """
    found = spans(docs)
    both = F.array_sort(F.concat("base", "added"))
    name = lambda k: F.get(F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS]), k)
    blocks = F.regexp_extract_all(F.col("text"), F.lit(rf"(?s).{{1,{TEXT_BLOCK}}}"), F.lit(0))

    def piece(cut, a, b):
        """The text from one place to another, of its blocks."""
        i, j = F.floor(a / TEXT_BLOCK).cast("int"), F.floor(b / TEXT_BLOCK).cast("int")
        head, last = F.coalesce(F.get(cut, i), F.lit("")), F.coalesce(F.get(cut, j), F.lit(""))
        far = F.concat(F.substring(head, a % TEXT_BLOCK + 1, F.lit(TEXT_BLOCK)), F.array_join(F.slice(cut, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(last, F.lit(1), b % TEXT_BLOCK))
        return F.when(i == j, F.substring(head, a % TEXT_BLOCK + 1, b - a)).otherwise(far)

    def written(cut, found):
        ends = scanned(found, F.lit(0), lambda at, s: F.greatest(at, s["stop"]), lambda at, s: F.struct(at.alias("at"), s["start"].alias("start"), s["kind"].alias("kind")), "struct<at:int,start:int,kind:int>")
        # A span that starts before the one before it has ended lies in that one's name.
        kept = F.filter(ends, lambda e: e["start"] >= e["at"])
        tail = piece(cut, F.array_max(F.transform(found, lambda s: s["stop"])), F.length("text"))
        return F.concat(F.array_join(F.transform(kept, lambda e: F.concat(piece(cut, e["at"], e["start"]), name(e["kind"]))), ""), tail)

    whole = bound(blocks, lambda cut: bound(F.col("_spans"), lambda found: written(cut, found)))
    text = F.when(F.size("_spans") > 0, whole).otherwise(F.col("text"))
    out = found.withColumn("_spans", both).withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
