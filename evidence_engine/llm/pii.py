"""Personal data: fixed patterns, then candidates judged by boosted trees; DataFrame functions only.

Fixed patterns give the base spans, which always stay. High-recall generators propose more spans, which
may overlap. Each proposal is described by small whole-number features of its format and context. Boosted
trees are fitted to the proposals of labelled examples (pii_examples.py: planted personal data in other
forms than the base patterns', and planted look-alikes); a proposal is right if it is what was planted,
from end to end. The driver gets a row for each kind of proposal with how often it was right. A threshold
for each generator is calibrated on a held-out fifth of the examples. The trees become nested conditions,
and each text's proposals are filtered by them inside its row: no row is moved. Of what passes, base spans
stay, then what doesn't overlap anything of a better score.

Java finds matches only without their places. Their places follow from the lengths of what split() leaves
between them, summed by doubling, and matches bring their surroundings along, so a text costs about its
length however many matches it has.

Defined results: null and empty texts have no spans (SHA-256 of the empty string); repeated rows and
doc_ids are judged row by row; without proposals nothing is added; spans of any length are found whole; an
empty table gives no rows; columns beside doc_id and text are not read by found() and are kept by redacted().
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_engine.llm import pii_examples
from evidence_engine.llm.common import written

KINDS = ("email", "ip", "card", "phone", "secret")
LOCAL, LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
#: Stands for a dot that no label follows or precedes; the text's own are moved out of its way.
DOT, OTHER = "\ue000", "\ue001"
EMAIL = rf"(?:(?<![{DOT}{LOCAL}])|\G)[{DOT}{LOCAL}]++@[{LABEL}]++\.[{LABEL}.]++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9\x20-])[0-9\x20-]{14,37}+(?![0-9\x20-])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Generators: whole runs of digits, numbers in the form of phones, all card numbers among digit groups, things around an at sign however it is written, keys with values.
DIGITS = r"(?<![0-9A-Za-z])\(?[0-9][0-9\x20().-]{6,}(?<=[0-9])(?![0-9A-Za-z])"
PHONES = r"(?<![0-9A-Za-z])(?:1[\x20.-])?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])"
#: Digits with what may stand between their groups; the start of a group but the first; from there up to 20 digits; a card's numbers of digits.
RUN = r"[0-9][0-9\x20().-]++"
GROUP = r"(?<=[^0-9])(?=[0-9])"
TAIL = r"(?<![0-9])(?=([0-9](?:[^0-9]*+[0-9]){12,19}))"
CARD_DIGITS = range(13, 20)
#: Digits of a card network's numbers, and how such numbers are written.
NETWORK = r"^(?:4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})|(?=[0-9]{16}$)(?:5[1-5]|222[1-9]|22[3-9]|2[3-6]|27[01]|2720)[0-9]*|3[47][0-9]{13}|3(?:0[0-5]|[68][0-9])[0-9]{11}|(?=[0-9]{16,19}$)(?:6011|64[4-9]|65|62|35[2-8])[0-9]*)$"
WRITTEN = r"^(?:[0-9]+|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?:\1[0-9]{3})?|[0-9]{4}([\x20-])[0-9]{6}\2[0-9]{4,5})$"
AT = r"(?<![^\s@()\[\]])[^\s@()\[\]]++\x20?(?:@|[(\[]at[)\]])\x20?[^\s@()\[\]]+(?<![.,;:!?'\x22])"
SECRET = r"(?i)(?<![A-Za-z])(?:token|secret|passw(?:or)?d|api[_-]?key)[\"']?\s{0,3}[:=]\s{0,3}[\"']?[A-Za-z0-9+/_-]{8,}+"
CUES = r"(?i)(?:phone|tel|call|mobile|fax|mail|contact|reach me|card|visa|server|host|address|token|secret)"
#: Forms of numbers, by which one is the first to fit; from 1. Groups repeat possessively: Java would nest a call for each of them.
SHAPES = (
    r"^(?:1[\x20.-])?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}$", r"^(?:[0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-](?:[0-9]{4}|[0-9]{2}))$", r"^(?:(?:19|20)[0-9]{2}[\x20-]+)++(?:19|20)[0-9]{2}$",
    r"^[0-9]{4}(?:[\x20-][0-9]{4})++$", r"^\(?0[0-9]{1,3}\)?(?:[\x20-][0-9]{2,})++$", r"^[0-9]{1,3}(?:[.\x20][0-9]{3})++$", r"^[0-9]+$",
)
WINDOW = 24
FEATURES = ("gen", "digits", "luhn", "quad", "plus", "at", "tld", "groups", "brackets", "shape", "mixed", "size", "glued", "cue")
GENERATORS = ("digits", "at", "secret")
ROUNDS, DEPTH, RATE, PRECISION = 24, 3, 0.3, 0.99
#: Labelled examples that the trees are fitted to.
EXAMPLES = 2_400
#: Characters of the parts that long texts are cut into to take pieces out.
PART = 2048
FOUND = "array<struct<start:int,end:int,found:string,before:string,after:string>>"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value worked out once: a lambda's own expressions are worked out for each element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def running(values: Column, both: Callable[[Column, Column], Column]) -> Column:
    """Each element with all before it: both() of neighbours, then of neighbouring pairs, of fours and so on."""

    def doubled(v: Column) -> Column:
        steps = F.when(F.size(v) > 1, F.sequence(F.lit(0), F.ceil(F.log2(F.size(v))).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
        shift = lambda i, k: i - F.call_function("shiftleft", F.lit(1), k)
        return F.aggregate(steps, v, lambda a, k: F.transform(a, lambda x, i: F.when(shift(i, k) >= 0, both(x, F.get(a, shift(i, k)))).otherwise(x)))

    return let(values, doubled)


def sums(values: Column) -> Column:
    return running(values, lambda x, y: x + y)


def places(text: Column, pattern: str) -> Column:
    """Where pattern matches text (FOUND): start and end (code points, end exclusive), the match, what is before it (up to WINDOW characters) and after it (one)."""
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda g, m: F.struct(g.alias("gap"), m.alias("found")))

    def placed(p: Column) -> Column:
        ends = sums(F.transform(p, lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["found"]), F.lit(0))))
        return let(ends, lambda e: F.filter(F.transform(p, lambda x, i: one(p, e, x, i)), lambda x: x["found"].isNotNull()))

    def one(p: Column, e: Column, x: Column, i: Column) -> Column:
        last, following = F.get(p, i - 1), F.get(p, i + 1)
        before = F.right(F.concat(F.coalesce(last["found"], F.lit("")), x["gap"]), F.lit(WINDOW))
        after = F.left(F.concat(F.coalesce(following["gap"], F.lit("")), F.coalesce(following["found"], F.lit(""))), F.lit(1))
        return F.struct((F.get(e, i) - F.length(x["found"])).alias("start"), F.get(e, i).alias("end"), x["found"].alias("found"), before.alias("before"), after.alias("after"))

    return let(pairs, placed).cast(FOUND)


def card_windows(text: Column) -> Column:
    """Whole digit groups that stand next to each other and make a card number (FOUND); they may overlap."""

    def windows(tail: Column) -> Column:
        matches = F.array(*[F.regexp_extract(tail, rf"^[0-9](?:[^0-9]*+[0-9]){{{n - 1}}}(?![0-9])", 0) for n in CARD_DIGITS])
        return F.filter(matches, lambda m: (F.length(m) > 0) & F.call_function("luhn_check", only_digits(m)))

    def of_run(run: Column) -> Column:
        # tails are those of the first groups: the last ones have too few digits after them
        groups = F.zip_with(F.split(run["found"], GROUP, -1), F.regexp_extract_all(run["found"], F.lit(TAIL), F.lit(1)), lambda g, t: F.struct(g.alias("group"), F.coalesce(t, F.lit("")).alias("tail")))
        return let(groups, lambda g: let(sums(F.transform(g, lambda x: F.length(x["group"]))), lambda ends: F.flatten(F.transform(g, lambda x, i: of_group(run, g, ends, x, i)))))

    def of_group(run: Column, g: Column, ends: Column, x: Column, i: Column) -> Column:
        start = run["start"] + F.get(ends, i) - F.length(x["group"])
        before = F.when(i == 0, run["before"]).otherwise(F.right(F.get(g, i - 1)["group"], F.lit(WINDOW)))
        # only at the end of its run can a window touch anything but what separates groups
        after = lambda m: F.when(start + F.length(m) >= run["end"], run["after"]).otherwise(F.lit(" "))
        return F.transform(windows(x["tail"]), lambda m: F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("found"), before.alias("before"), after(m).alias("after")))

    runs = F.filter(places(text, RUN), lambda r: F.length(only_digits(r["found"])) >= CARD_DIGITS[0])
    return F.flatten(F.transform(runs, of_run)).cast(FOUND)


def if_any(condition: Column, spans: Column) -> Column:
    return F.when(condition, spans).otherwise(F.array().cast(FOUND))


def only_digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of at most 40 digits passes."""
    return F.coalesce(F.call_function("luhn_check", digits), F.lit(False))


def quad(s: Column) -> Column:
    """Whether s is four numbers of at most 255 with dots between them; leading zeros don't count."""
    return F.forall(F.split(s, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+(?=[0-9])", "")) <= 3) & F.forall(F.split(s, r"\."), lambda p: F.coalesce(F.substring(p, -3, 3).try_cast("int"), F.lit(999)) <= 255)


def base_spans(text: Column) -> Column:
    """All base spans of text: array of (start, end, kind), kind by its place in KINDS, in the contract's order."""
    moved = F.regexp_replace(F.translate(text, DOT, OTHER), rf"(?<![{LABEL}])\.|\.(?![{LABEL}])", DOT)
    email = if_any(F.contains(text, F.lit("@")), places(moved, EMAIL))
    ip = if_any(F.rlike(text, F.lit(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")), F.filter(places(text, IP), lambda s: quad(s["found"])))
    joined = F.regexp_replace(text, r"(?<![0-9])[\x20-]|[\x20-](?![0-9])", "x")
    long_run = F.rlike(text, F.lit(r"[0-9](?:[\x20-]?[0-9]){13}"))
    card = if_any(long_run, F.filter(places(joined, CARD), lambda s: F.length(only_digits(s["found"])).between(14, 19) & luhn(only_digits(s["found"]))))
    phone = if_any(F.rlike(text, F.lit(r"\+[0-9]")), F.filter(places(text, PHONE), lambda s: F.length(only_digits(s["found"])).between(10, 15)))
    tag = lambda k: lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end"))
    tagged = [F.transform(spans, tag(k)) for k, spans in enumerate((email, ip, card, phone))]
    return F.array_sort(F.concat(*tagged))


def proposals(text: Column) -> Column:
    """What the generators propose: places with features."""
    digits = if_any(F.rlike(text, F.lit(r"[0-9][0-9\x20().-]{6}")), F.concat(places(text, DIGITS), places(text, PHONES)))
    cards = if_any(F.rlike(text, F.lit(r"[0-9](?:[\x20().-]*+[0-9]){12}")), card_windows(text))
    at = if_any(F.contains(text, F.lit("@")) | F.rlike(text, F.lit(r"[(\[]at[)\]]")), places(text, AT))
    secret = if_any(F.rlike(text, F.lit(r"(?i)(?:token|secret|passw(?:or)?d|api[_-]?key)[\"']?\s{0,3}[:=]")), places(text, SECRET))
    tag = lambda k: lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(k).alias("gen"), s["found"].alias("found"), s["before"].alias("before"), s["after"].alias("after"))
    tagged = F.concat(*[F.transform(spans, tag(k)) for k, spans in enumerate((F.concat(digits, cards), at, secret))])

    def described(s: Column) -> Column:
        found, before, after = s["found"], s["before"], s["after"]
        n = F.length(only_digits(found))
        number = lambda c: c.cast("int")
        value = F.regexp_extract(found, r"[A-Za-z0-9+/_-]+$", 0)
        format_ = F.rlike(only_digits(found), F.lit(NETWORK)) & F.rlike(found, F.lit(WRITTEN))
        card = F.when(n.between(CARD_DIGITS[0], 40) & luhn(only_digits(found)), 1 + number(format_)).otherwise(0)
        features = {
            "gen": s["gen"],
            "digits": F.when(n < 8, 0).when(n < 10, 1).when(n == 10, 2).when(n < 13, 3).when(n < 16, 4).when(n == 16, 5).otherwise(6),
            "luhn": card,
            "quad": number(F.rlike(found, F.lit(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$")) & quad(found)),
            "plus": number(F.endswith(before, F.lit("+"))),
            "at": F.when(F.rlike(found, F.lit(r"[(\[]at[)\]]")), 3).when(F.contains(found, F.lit(" @")) | F.contains(found, F.lit("@ ")), 2).when(F.contains(found, F.lit("@")), 1).otherwise(0),
            "tld": number(F.rlike(found, F.lit(r"[A-Za-z0-9-]\.[A-Za-z]{2,}$"))),
            "groups": F.least(F.lit(6), F.size(F.split(found, r"[^0-9A-Za-z]+", -1)) - 1),
            "brackets": number(F.rlike(found, F.lit(r"^\([0-9]{2,4}\)"))),
            "shape": reduce(lambda c, k: c.when(F.rlike(found, F.lit(SHAPES[k])), k + 1), range(1, len(SHAPES)), F.when(F.rlike(found, F.lit(SHAPES[0])), 1)).otherwise(0),
            "mixed": number(F.rlike(value, F.lit("[0-9]"))) + number(F.rlike(value, F.lit("[A-Za-z]"))),
            "size": F.when(F.length(value) < 12, 0).when(F.length(value) < 20, 1).when(F.length(value) < 32, 2).otherwise(3),
            "glued": number(F.rlike(before, F.lit(r"[\p{L}0-9]$"))) + number(F.rlike(after, F.lit(r"^[\p{L}0-9]"))),
            "cue": number(F.rlike(before, F.lit(CUES))),
        }
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), *[features[k].cast("int").alias(k) for k in FEATURES])

    return F.transform(tagged, described)


class Trees:
    """Boosted trees for weighted rows of small whole-number features: logistic loss, Newton steps."""

    def __init__(self, rows: list[tuple[tuple[int, ...], float, float]], rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE):
        """rows: (features, weight that is personal data, weight that is not)."""
        yes, no = sum(r[1] for r in rows), sum(r[2] for r in rows)
        self.start, self.trees = math.log((yes + 0.5) / (no + 0.5)), []
        score = [self.start] * len(rows)
        for _ in range(rounds if yes and no else 0):
            grads = []
            for (_, a, b), s in zip(rows, score, strict=True):
                p = 1 / (1 + math.exp(-max(-30.0, min(30.0, s))))
                grads.append((a - (a + b) * p, (a + b) * p * (1 - p)))
            tree = self.node(rows, grads, list(range(len(rows))), depth, rate)
            self.trees.append(tree)
            score = [s + self.leaf(tree, r[0]) for s, r in zip(score, rows, strict=True)]

    def node(self, rows, grads, inside, depth, rate):
        g, h = sum(grads[i][0] for i in inside), sum(grads[i][1] for i in inside)
        worth, best = g * g / (h + 1.0), None
        for f in range(len(FEATURES)) if depth else ():
            by_value: dict[int, list[float]] = {}
            for i in inside:
                of = by_value.setdefault(rows[i][0][f], [0.0, 0.0])
                of[0] += grads[i][0]
                of[1] += grads[i][1]
            a = b = 0.0
            for v in sorted(by_value)[:-1]:
                a, b = a + by_value[v][0], b + by_value[v][1]
                gain = a * a / (b + 1.0) + (g - a) ** 2 / (h - b + 1.0) - worth
                if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, f, v)
        if best is None:
            return rate * g / (h + 1.0)
        _, f, v = best
        low, high = [i for i in inside if rows[i][0][f] <= v], [i for i in inside if rows[i][0][f] > v]
        return (f, v, self.node(rows, grads, low, depth - 1, rate), self.node(rows, grads, high, depth - 1, rate))

    def leaf(self, tree, x) -> float:
        while isinstance(tree, tuple):
            tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
        return tree

    def score(self, x) -> float:
        return self.start + sum(self.leaf(t, x) for t in self.trees)

    def column(self, c: Column) -> Column:
        """The score as nested conditions over the fields of c."""

        def nested(t):
            return F.when(c[FEATURES[t[0]]] <= t[1], nested(t[2])).otherwise(nested(t[3])) if isinstance(t, tuple) else F.lit(float(t))

        return reduce(lambda a, b: a + b, map(nested, self.trees), F.lit(float(self.start)))


class Model:
    """Trees and a threshold for each generator."""

    def __init__(self, trees: Trees, thresholds: list[float]):
        self.trees, self.thresholds = trees, thresholds

    def least(self, c: Column) -> Column:
        """The score that c has to have."""
        return F.element_at(F.array(*map(F.lit, self.thresholds)), c["gen"] + 1)


def with_spans(docs: DataFrame) -> DataFrame:
    """Adds whole (the text, null: empty), base and proposed."""
    rows = docs.withColumn("whole", F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = rows.withColumn("base", base_spans(F.col("whole")))
    return rows.withColumn("proposed", proposals(F.col("whole")))


def examples(spark: SparkSession, n: int = EXAMPLES) -> DataFrame:
    """pii_examples.made(n) as a table; written at once, so that plans over it don't carry all texts."""
    rows = F.from_json(F.lit(json.dumps(pii_examples.made(n))), "array<struct<id:int,text:string,start:int,end:int,kind:string,personal:boolean>>")
    return written(spark.range(1).select(F.inline(rows)), "pii-examples")


def judged_examples(spark: SparkSession, n: int = EXAMPLES, held_out: int = 5) -> list:
    """Rows (held, kind, FEATURES, yes, no): how many proposals with these features are what was planted, from end to end, and are not.

    Only those count that meet what was planted; eight examples in a row have all kinds, so folds are of eights.
    """
    near = lambda c, k: F.abs(F.col(f"c.{k}") - F.col(k)) <= 1
    rows = with_spans(examples(spark, n)).withColumn("c", F.explode("proposed")).where("c.start < end and start < c.end")
    yes = (F.col("personal") & near("c", "start") & near("c", "end")).cast("long")
    held = F.expr(f"(id div 8) % {held_out} = 0")
    return rows.groupBy(held.alias("held"), "kind", *[F.col(f"c.{k}").alias(k) for k in FEATURES]).agg(F.sum(yes).alias("yes"), F.sum(1 - yes).alias("no")).orderBy("held", "kind", *FEATURES).collect()


def fit(spark: SparkSession, n: int = EXAMPLES, precision: float = PRECISION) -> Model:
    """Trees of n labelled examples, and for each generator the least score at which the held-out ones have that precision."""
    kinds = judged_examples(spark, n)
    table = lambda held: [(tuple(r[k] for k in FEATURES), float(r["yes"]), float(r["no"])) for r in kinds if r["held"] == held]
    trees = Trees(table(False))
    thresholds = []
    for g in range(len(GENERATORS)):
        ranked = sorted(((trees.score(x), yes, no) for x, yes, no in table(True) if x[0] == g), reverse=True)
        least, a, b = float("inf"), 0.0, 0.0
        for k, (s, yes, no) in enumerate(ranked):
            a, b = a + yes, b + no
            if (k + 1 == len(ranked) or ranked[k + 1][0] < s) and a >= precision * (a + b):
                # halfway to what is refused: kinds that the held-out examples lack are nearer to one or the other
                least = (s + ranked[k + 1][0]) / 2 if k + 1 < len(ranked) else s
        thresholds.append(max(least, 0.0))
    return Model(trees, thresholds)


ITEM = "struct<worse:double,start:int,kind:int,end:int,base:boolean>"


def spans(rows: DataFrame, model: Model) -> DataFrame:
    """Adds spans: the base ones, and the selected proposals that overlap neither those nor a kept one of a better score (then the first)."""
    kind = lambda c: F.when(c["gen"] == 2, 4).when(c["gen"] == 1, 0).when(c["quad"] == 1, 1).when(c["luhn"] > 0, 2).otherwise(3)
    item = lambda worse, s, kind, base: F.struct(worse.alias("worse"), s["start"].alias("start"), kind.alias("kind"), s["end"].alias("end"), F.lit(base).alias("base")).cast(ITEM)
    scored = F.transform("proposed", lambda c: F.struct(c.alias("c"), model.trees.column(c).alias("score")))
    picked = F.transform(F.filter(scored, lambda x: x["score"] >= model.least(x["c"])), lambda x: item(-x["score"], x["c"], kind(x["c"]), False))
    base = F.transform("base", lambda b: item(F.lit(-1e9), b, b["kind"], True))
    meet = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    kept = lambda a, c: F.when(~c["base"] & F.exists(a, lambda d: meet(d, c)), a).otherwise(F.concat(a, F.array(c)))
    best = lambda group: F.when(F.size(group) > 1, F.aggregate(F.array_sort(group), F.slice(group, 1, 0), kept)).otherwise(group)
    # overlaps stay within groups: the next one begins where all before it have ended
    by_start = lambda x, y: F.when(x["start"] < y["start"], -1).when(x["start"] > y["start"], 1).otherwise(0)
    cut = lambda a: F.transform(groups_of(a), lambda g: best(F.slice(a, g["first"] + 1, g["many"])))
    every = F.flatten(let(F.array_sort(F.concat(base, "picked"), by_start), cut))
    plain = lambda a: F.array_sort(F.transform(a, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    rows = rows.withColumn("picked", picked)
    return rows.withColumn("spans", F.when(F.size("picked") > 0, plain(every)).otherwise(F.col("base"))).drop("picked")


def groups_of(a: Column) -> Column:
    """Groups of overlapping spans in an array that is sorted by start: array of (first, many, end)."""

    def grouped(upto: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: (i == 0) | (F.get(a, i)["start"] >= F.get(upto, i - 1)))
        following = lambda f, j: F.coalesce(F.get(f, j + 1), F.size(a))
        return let(first, lambda f: F.transform(f, lambda i, j: F.struct(i.alias("first"), (following(f, j) - i).alias("many"), F.get(upto, following(f, j) - 1).alias("end"))))

    return let(running(F.transform(a, lambda x: x["end"]), lambda x, y: F.greatest(x, y)), grouped)


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def found(docs: DataFrame) -> DataFrame:
    """Base counts and digest, and all spans, of every document."""
    rows = spans(with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), fit(docs.sparkSession))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return rows.select("doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(4)], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, mark: str = "<{}>") -> DataFrame:
    """The documents, with columns as they are but each span in the text replaced by its kind's mark."""
    columns = docs.columns
    rows = spans(with_spans(docs.select(F.struct(*columns).alias("doc"), "doc_id", "text")), fit(docs.sparkSession))
    marks = F.array(*[F.lit(mark.format(k.upper())) for k in KINDS])

    def piece(parts: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / PART).cast("int")
        joined = F.array_join(F.slice(parts, first + 1, F.floor(end / PART).cast("int") - first + 1), "")
        return F.substring(joined, start - first * PART + 1, end - start)

    def cleaned(parts: Column) -> Column:
        # of overlapping spans the first one's mark stands for all
        def around(groups: Column) -> Column:
            each = F.transform(groups, lambda g, j: F.concat(piece(parts, F.coalesce(F.get(groups, j - 1)["end"], F.lit(0)), F.get(F.col("spans"), g["first"])["start"]), F.element_at(marks, F.get(F.col("spans"), g["first"])["kind"] + 1)))
            return F.concat(F.array_join(each, ""), piece(parts, F.element_at(groups, -1)["end"], F.length("whole")))

        return let(groups_of(F.col("spans")), around)

    parts = F.regexp_extract_all("whole", F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))
    text = F.when(F.size("spans") > 0, let(parts, cleaned)).otherwise(F.col("doc.text"))
    return rows.select(*[text.alias("text") if c == "text" else F.col("doc")[c].alias(c) for c in columns])
