"""Full-text search: match grammar, BM25.

A query is parsed on the driver into phrases and a boolean tree over them, and compiled into columns over
token arrays: one scan computes every phrase's frequency and observes the corpus numbers (over the whole table, before
any filter); its hits are kept and scored. Nothing is shuffled but one row of sums. A stored `TextIndex` (postings by
term) tells which rows need to be read at all.

Grammar: words (all must match), "phrases", prefix*, AND OR NOT (upper case), parentheses, column: filters
and {a b}: lists, NEAR(a b, n), + between parts of a phrase. Anything else raises MatchError; `match`
then takes the whole text as one phrase.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quillgraph.functions.text import counted, let, plain_token, search_tokens

#: Okapi BM25, and the weight of a term in half of all rows or more.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


class MatchError(ValueError):
    """The text is not a query of the grammar."""


@dataclass(frozen=True)
class Phrase:
    tokens: tuple[str, ...]
    prefix: bool = False
    columns: tuple[str, ...] | None = None
    first: bool = False  # must stand at a column's start


@dataclass(frozen=True)
class Near:
    phrases: tuple[Phrase, ...]
    distance: int


@dataclass
class Node:
    op: str  # leaf, and, or, not
    parts: list = field(default_factory=list)  # phrases (leaf: one Phrase or Near) or nodes


# ------------------------------------------------------------------ parser


def _lex(text: str) -> list[tuple[str, str]]:
    out, i = [], 0
    while i < len(text):
        ch = text[i]
        if ch.isspace():
            i += 1
        elif ch == '"':
            value, i = "", i + 1
            while True:
                if i >= len(text):
                    raise MatchError("unclosed quote")
                if text[i] == '"':
                    if text[i + 1 : i + 2] != '"':
                        break
                    i += 1
                value += text[i]
                i += 1
            out.append(("string", value))
            i += 1
        elif ch in "(){}:,+*-^":
            out.append((ch, ch))
            i += 1
        elif ch.isascii() and not (ch.isalnum() or ch == "_"):
            raise MatchError(f"{ch!r} can't stand here")
        else:
            j = i
            while j < len(text) and (not text[j].isascii() or text[j].isalnum() or text[j] == "_"):
                j += 1
            word = text[i:j]
            out.append((word if word in ("AND", "OR", "NOT") else "word", word))
            i = j
    return out


class _Parser:
    def __init__(self, text: str, columns: tuple[str, ...]):
        self.items, self.at, self.columns = _lex(text), 0, columns

    def peek(self, ahead: int = 0) -> str:
        i = self.at + ahead
        return self.items[i][0] if i < len(self.items) else "end"

    def take(self, *kinds: str) -> str:
        if self.peek() not in kinds:
            raise MatchError(f"{self.peek()} can't stand here")
        self.at += 1
        return self.items[self.at - 1][1]

    def query(self) -> Node:
        node = self.either(None)
        self.take_end()
        return node

    def take_end(self) -> None:
        if self.peek() != "end":
            raise MatchError(f"{self.peek()} can't stand here")

    def either(self, columns) -> Node:
        parts = [self.both(columns)]
        while self.peek() == "OR":
            self.take("OR")
            parts.append(self.both(columns))
        return parts[0] if len(parts) == 1 else Node("or", parts)

    def both(self, columns) -> Node:
        parts = [self.without(columns)]
        while self.peek() == "AND":
            self.take("AND")
            parts.append(self.without(columns))
        return parts[0] if len(parts) == 1 else Node("and", parts)

    def without(self, columns) -> Node:
        node = self.row(columns)
        while self.peek() == "NOT":
            self.take("NOT")
            node = Node("not", [node, self.row(columns)])
        return node

    def row(self, columns) -> Node:
        """Neighbours without an operator: all must match."""
        parts = [self.one(columns)]
        while self.peek() in ("word", "string", "(", "{", "^", "-"):
            parts.append(self.one(columns))
        return parts[0] if len(parts) == 1 else Node("and", parts)

    def column_filter(self) -> tuple[str, ...] | None:
        start, minus = self.at, False
        if self.peek() == "-":
            minus = True
            self.take("-")
        names: list[str] = []
        if self.peek() == "{":
            self.take("{")
            while self.peek() in ("word", "string"):
                names.append(self.take("word", "string"))
            self.take("}")
        elif self.peek() in ("word", "string") and self.peek(1) == ":":
            names.append(self.take("word", "string"))
        if names and self.peek() == ":":
            self.take(":")
            unknown = [n for n in names if n.lower() not in self.columns]
            if unknown:
                raise MatchError(f"no such column: {unknown[0]}")
            chosen = tuple(n.lower() for n in names)
            return tuple(c for c in self.columns if (c in chosen) != minus)
        if minus or self.at != start and names:
            raise MatchError("a column filter needs a colon")
        self.at = start
        return None

    def one(self, columns) -> Node:
        own = self.column_filter()
        if own is not None:
            columns = own if columns is None else tuple(c for c in own if c in columns)
        if self.peek() == "(":
            self.take("(")
            node = self.either(columns)
            self.take(")")
            return node
        if self.peek() == "word" and self.items[self.at][1] == "NEAR" and self.peek(1) == "(":
            self.take("word")
            self.take("(")
            phrases, distance = [], 10
            while self.peek() in ("word", "string"):
                phrases.append(self.phrase(columns))
            if self.peek() == ",":
                self.take(",")
                number = self.take("word")
                if not number.isdigit():
                    raise MatchError("NEAR needs a number")
                distance = int(number)
            self.take(")")
            if not phrases:
                raise MatchError("NEAR needs phrases")
            return Node("leaf", [Near(tuple(phrases), distance)])
        first = self.peek() == "^"
        if first:
            self.take("^")
        return Node("leaf", [self.phrase(columns, first)])

    def phrase(self, columns, first: bool = False) -> Phrase:
        tokens = plain_token(self.take("word", "string"))
        while self.peek() == "+":
            self.take("+")
            tokens += plain_token(self.take("word", "string"))
        prefix = self.peek() == "*"
        if prefix:
            self.take("*")
        return Phrase(tuple(tokens), prefix, columns, first)


def parse(text: str, columns: tuple[str, ...]) -> Node:
    return _Parser(text, columns).query()


def as_phrase(text: str) -> Node:
    """The whole text as one quoted phrase."""
    return Node("leaf", [Phrase(tuple(plain_token(text)))])


def parsed_or_phrase(text: str, columns: tuple[str, ...]) -> Node:
    try:
        return parse(text, columns)
    except MatchError:
        return as_phrase(text)


# ------------------------------------------------------------------ compilation


def _starts(tokens: Column, p: Phrase) -> Column:
    """Positions (from 0) at which a phrase stands in a token array."""
    n = len(p.tokens)
    none = F.expr("cast(array() as array<int>)")
    if not n:
        return none

    def stands(i: Column) -> Column:
        out = (i == 0) if p.first else F.lit(True)
        for k, t in enumerate(p.tokens):
            own = F.get(tokens, i + k)
            out = out & F.coalesce(own.startswith(t) if p.prefix and k == n - 1 else own == t, F.lit(False))
        return out

    return F.when(F.size(tokens) >= n, F.filter(F.sequence(F.lit(0), F.size(tokens) - n), stands)).otherwise(none)


def _count(tokens: Column, p: Phrase) -> Column:
    if len(p.tokens) == 1 and not p.first:
        t = p.tokens[0]
        return F.size(F.filter(tokens, lambda w: w.startswith(t) if p.prefix else w == t))
    return let(tokens, lambda t: F.size(_starts(t, p)))


def _near_count(tokens: Column, near: Near, which: int) -> Column:
    """Places of phrase `which` that stand near one of each other phrase."""
    phrases = near.phrases
    others = [i for i in range(len(phrases)) if i != which]

    def close(chosen: dict[int, Column]) -> Column:
        top = F.greatest(*chosen.values()) if len(chosen) > 1 else next(iter(chosen.values()))
        out = F.lit(True)
        for i, at in chosen.items():
            out = out & (at + len(phrases[i].tokens) + near.distance >= top)
        return out

    def search(all_starts: Column, left: list[int], chosen: dict[int, Column]) -> Column:
        if not left:
            return close(chosen)
        return F.exists(all_starts[left[0]], lambda x: search(all_starts, left[1:], chosen | {left[0]: x}))

    def places(t: Column) -> Column:
        starts = [_starts(t, p) for p in phrases]
        return let(F.array(*starts), lambda all_starts: F.size(F.filter(all_starts[which], lambda x: search(all_starts, others, {which: x}))))

    return let(tokens, places)


def units(node: Node) -> list[tuple[object, int]]:
    """The phrases of a tree in order: (leaf, number in it)."""
    if node.op == "leaf":
        leaf = node.parts[0]
        return [(leaf, i) for i in range(len(leaf.phrases))] if isinstance(leaf, Near) else [(leaf, 0)]
    return [u for part in node.parts for u in units(part)]


def _frequency(leaf: object, i: int, tokens: dict[str, Column]) -> Column:
    phrase = leaf.phrases[i] if isinstance(leaf, Near) else leaf
    names = tokens if phrase.columns is None else [c for c in tokens if c in phrase.columns]
    counts = [_near_count(tokens[c], leaf, i) if isinstance(leaf, Near) and len(leaf.phrases) > 1 else _count(tokens[c], phrase) for c in names]
    return sum(counts, F.lit(0)) if counts else F.lit(0)


def _holds(node: Node, tf: dict[int, Column], numbers: dict[int, int]) -> Column:
    if node.op == "leaf":
        leaf = node.parts[0]
        if not isinstance(leaf, Near) and not leaf.tokens:
            return F.lit(False)
        start = numbers[id(node)]
        out = F.lit(True)
        for i in range(len(leaf.phrases) if isinstance(leaf, Near) else 1):
            out = out & (tf[start + i] > 0)
        return out
    parts = [_holds(p, tf, numbers) for p in node.parts]
    if node.op == "not":
        return parts[0] & ~parts[1]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if node.op == "and" else out | p
    return out


def _counted(node: Node, tf: dict[int, Column], numbers: dict[int, int], inside: Column, out: dict[int, Column]) -> None:
    """For each phrase whether its places count in a row that matches: every part around it must hold, and
    what NOT takes away never counts."""
    if node.op == "leaf":
        for i in range(len(units(node))):
            out[numbers[id(node)] + i] = inside
        return
    for n, part in enumerate(node.parts):
        holds = F.lit(False) if node.op == "not" and n else inside & _holds(part, tf, numbers) if node.op == "or" else inside
        _counted(part, tf, numbers, holds, out)


def _number(node: Node, numbers: dict[int, int], at: int = 0) -> int:
    if node.op == "leaf":
        numbers[id(node)] = at
        return at + len(units(node))
    for part in node.parts:
        at = _number(part, numbers, at)
    return at


def match(rows: DataFrame, text: str, columns: dict[str, str], keep: Column | None = None, index: TextIndex | None = None) -> DataFrame:
    """The rows that match, with their BM25 score `bm25` (higher is better), without the searched columns.

    columns: the searched columns by the name that queries may use. Corpus numbers come from all
    `rows`; `keep` is a filter on the result alone. One pass over `rows` counts and keeps the hits. With an index, only
    rows that hold all words of a phrase are read: no other can match or count for a phrase.
    """
    if index is not None:
        rows = rows.join(index.candidates(parsed_or_phrase(text, tuple(columns))), index.key, "left_semi")
    node = parsed_or_phrase(text, tuple(columns))
    found, numbers = units(node), {}
    _number(node, numbers)
    names = {c: f"__tokens_{c}" for c in columns}
    parts = rows.withColumns({names[c]: search_tokens(F.col(source)) for c, source in columns.items()})
    size = sum((F.size(t) for t in names.values()), F.lit(0))
    tokens = {c: F.col(t) for c, t in names.items()}
    computed = {"__size": size}
    for k, (leaf, i) in enumerate(found):
        computed[f"__tf{k}"] = _frequency(leaf, i, tokens)
        # a phrase's rarity is its own, near others or not
        computed[f"__df{k}"] = _frequency(leaf.phrases[i], 0, tokens) if isinstance(leaf, Near) else computed[f"__tf{k}"]
    parts = parts.withColumns(computed).drop(*names.values(), *columns.values())
    tf = {k: F.col(f"__tf{k}") for k in range(len(found))}
    seen = Observation()
    sums = [F.count(F.lit(1)).alias("n"), F.avg("__size").alias("avg"), *(F.count(F.when(F.col(f"__df{k}") > 0, 1)).alias(f"df{k}") for k in tf)]
    hits = parts.observe(seen, *sums).filter(_holds(node, tf, numbers)).persist()
    # without hits Spark may not have run the plan that counts, and nothing is scored
    numbers_row = seen.get if hits.count() else {"n": 0, "avg": None} | {f"df{k}": 0 for k in tf}
    n, average = (numbers_row["n"], numbers_row["avg"] or 1.0) if index is None else (index.n, index.average or 1.0)
    counted: dict[int, Column] = {}
    _counted(node, tf, numbers, F.lit(True), counted)
    score = F.lit(0.0)
    for k in tf:
        c, df = F.when(counted[k], tf[k]).otherwise(0), numbers_row[f"df{k}"]
        idf = F.log(F.lit((n - df + 0.5) / (df + 0.5)))
        idf = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf)
        score = score + idf * c * (K1 + 1) / (c + K1 * (1 - B + B * F.col("__size") / F.lit(float(average))))
    if keep is not None:
        hits = hits.filter(keep)
    return hits.withColumn("bm25", score).drop(*computed)


# ------------------------------------------------------------------ index


#: Files of an index: a term's postings are in the one that its hash names.
BUCKETS = 64
POSTINGS = "term string, chunk_id string, path string, tf long, bucket int"


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def postings(rows: DataFrame, key: str, text: str, *carried: str, alone: bool = False) -> DataFrame:
    """The inverted index (term, the key, the carried columns, tf, bucket): one shuffle by (key, term), summed before it
    moves; none where each row has a key of its own (`alone`). Written partitioned by bucket, a query reads the files of
    its terms only."""
    tokens = search_tokens(F.col(text))
    if alone:
        each = rows.select(key, *carried, F.explode(counted(tokens)).alias("t"))
        summed = each.select(key, *carried, "t.term", F.col("t.n").alias("tf"))
    else:
        summed = rows.select(key, *carried, F.explode(tokens).alias("term")).groupBy(key, *carried, "term").agg(F.count("*").alias("tf"))
    return summed.select("term", key, *carried, "tf", bucket_of(F.col("term")).alias("bucket"))


def sizes(rows: DataFrame, key: str, text: str, *carried: str) -> DataFrame:
    """(the key, the carried columns, size): how many tokens each row has."""
    return rows.select(key, *carried, F.size(search_tokens(F.col(text))).alias("size"))


@dataclass
class TextIndex:
    """Postings of the rows to be searched, how many these are, and their mean number of tokens."""

    postings: DataFrame
    key: str
    n: int
    average: float

    def candidates(self, node: Node) -> DataFrame:
        """The keys of the rows that hold every token of one of the phrases: one read of the tokens' postings."""
        phrases = [leaf.phrases[i] if isinstance(leaf, Near) else leaf for leaf, i in units(node)]
        exact = sorted({t for p in phrases for t in (p.tokens[:-1] if p.prefix else p.tokens)})
        starts = sorted({p.tokens[-1] for p in phrases if p.prefix and p.tokens})
        term = F.col("term")
        wanted, tests = F.lit(False), {}
        if exact:
            # the buckets are known, so that only their files are listed and read
            known = self.postings.sparkSession.range(1).select(F.transform(F.lit(exact), bucket_of).alias("b")).first()["b"]
            wanted = F.col("bucket").isin(sorted(set(known))) & term.isin(exact)
            tests |= {("=", t): term == t for t in exact}
        for t in starts:
            wanted = wanted | term.startswith(t)
            tests["*", t] = term.startswith(t)
        held = {k: f"__h{i}" for i, k in enumerate(tests)}
        some = self.postings.filter(wanted).groupBy(self.key).agg(*(F.max(test).alias(held[k]) for k, test in tests.items())) if tests else self.postings.limit(0)
        either = F.lit(False)
        for p in phrases:
            last = len(p.tokens) - 1 if p.prefix else -1
            one = F.lit(bool(p.tokens))
            for i, t in enumerate(p.tokens):
                one = one & F.col(held["*" if i == last else "=", t])
            either = either | one
        return some.filter(either).select(self.key)


def score_postings(index: DataFrame, lengths: DataFrame, terms: list[str], key: str) -> DataFrame:
    """(the key, bm25) of the rows that hold all `terms`, from postings and sizes alone."""
    wanted = sorted({t for term in terms for t in plain_token(term)})
    numbers = lengths.agg(F.count("*").alias("n"), F.avg("size").alias("avg")).first()
    own = index.filter(F.col("term").isin(wanted))
    df = own.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.lit(numbers["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf)
    scored = own.join(F.broadcast(df), "term").join(lengths, key)  # df: one row a query term
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.lit(numbers["avg"] or 1.0)))
    return scored.groupBy(key).agg(F.sum(part).alias("bm25"), F.count("*").alias("held")).filter(F.col("held") == len(wanted)).drop("held")
