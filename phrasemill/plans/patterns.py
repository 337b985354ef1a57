"""Sequence patterns: XML to a small tree, and its matches in sentences.

Patterns without captures become one regular expression over a string with a letter per word, the letter telling which of
the pattern's word tests the word passes; everything runs in the JVM. Patterns with ignored parts, captures, repeats of
captures or dependencies are walked by an Arrow-batched matcher. Both enumerate all full matches of a span.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ATTRS = ("surface", "lemma", "pos", "syn")
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdef"
_NEXT_OF = {"?": (0, 1), "*": (0, None), "+": (1, None)}


@dataclass(frozen=True)
class Word:
    attrs: tuple[tuple[str, str], ...] = ()
    neg: tuple[tuple[tuple[str, str], ...], ...] = ()
    name: str | None = None
    syndep: str | None = None


@dataclass(frozen=True)
class Back:
    name: str


@dataclass(frozen=True)
class Group:
    items: tuple = ()
    either: bool = False
    repeat: tuple[int, int | None] = (1, 1)
    ignore: bool = False
    name: str | None = None
    anchor_start: bool = False
    anchor_end: bool = False


@dataclass(frozen=True)
class Span:
    places: tuple[int, ...]
    start: int
    end: int
    names: dict = field(default_factory=dict, compare=False)


def repeat_of(text: str | None) -> tuple[int, int | None]:
    if not text:
        return 1, 1
    if text in _NEXT_OF:
        return _NEXT_OF[text]
    m = re.fullmatch(r"\{(\d*)(?:(,)(\d*))?\}", text)
    if not m:
        raise ValueError(f"not a repeat: {text}")
    lo = int(m[1] or 0)
    return (lo, lo) if not m[2] else (lo, int(m[3]) if m[3] else None)


def _element(e: ET.Element):
    if e.tag == "w":
        attrs = tuple((a, e.attrib[a]) for a in ATTRS if a in e.attrib)
        neg = [tuple((a, n.attrib[a]) for a in ATTRS if a in n.attrib) for n in e if n.tag == "neg"]
        if "neg" in e.attrib:  # the older form: attributes of this word, negated
            turned = [a for a in e.attrib["neg"].split(":") if a]
            for a in turned:
                if a not in e.attrib:
                    raise ValueError(f"can't negate {a}, which has no value")
            neg += [((a, e.attrib[a]),) for a in turned]
            attrs = tuple(x for x in attrs if x[0] not in turned)
        word = Word(attrs, tuple(neg), e.attrib.get("id"), e.attrib.get("syndep"))
        return Group((word,), ignore=True) if e.attrib.get("ignore") in ("true", "1", "yes") else word
    if e.tag == "backpat":
        return Back(e.attrib["id"])
    if e.tag in ("pat", "either"):
        flag = lambda k: e.attrib.get(k, "").lower() in ("true", "1", "yes")
        return Group(tuple(_element(x) for x in e if x.tag in ("w", "pat", "either", "backpat")), e.tag == "either", repeat_of(e.attrib.get("repeat")), flag("ignore"), e.attrib.get("id"), flag("anchor_start"), flag("anchor_end"))
    raise ValueError(f"not part of a pattern: {e.tag}")


def parse(xml: str) -> list[Group]:
    """The top-level patterns of a document, or the one pattern that it is."""
    root = ET.fromstring(xml)
    return [_element(root)] if root.tag == "pat" else [_element(x) for x in root if x.tag == "pat"]


def ngram_pattern(lo: int, hi: int) -> Group:
    return Group((Group((Word(),), repeat=(lo, hi)),))


def _regex(value: str) -> str:
    return "^" + ".*".join(re.escape(x) for x in value.split("*")) + "$"


def word_test(w: Word, node: Column) -> Column:
    """Each attribute in full ('*' stands for anything); a negated one must not even begin with the value."""
    tests = [node[a].rlike("(?s)" + _regex(v)) if "*" in v else node[a] == v for a, v in w.attrs]
    for group in w.neg:
        tests += [~F.coalesce(node[a].rlike("(?s)" + _regex(v)[:-1]) if "*" in v else node[a].startswith(v), F.lit(False)) for a, v in group]
    return F.coalesce(reduce(lambda x, y: x & y, tests), F.lit(False)) if tests else F.lit(True)


def _plain(node) -> bool:
    if isinstance(node, Back):
        return False
    if isinstance(node, Word):
        return node.syndep is None and node.name is None and not any(v.startswith("back:") for _, v in node.attrs)
    return not node.ignore and node.name is None and all(map(_plain, node.items))


def _words(node) -> list[Word]:
    return [node] if isinstance(node, Word) else [] if isinstance(node, Back) else [w for x in node.items for w in _words(x)]


def _bounds(node) -> tuple[int, int | None]:
    if isinstance(node, Word):
        return 1, 1
    inner = [_bounds(x) for x in node.items] or [(0, 0)]
    if node.either:
        lo, hi = min(x for x, _ in inner), None if any(y is None for _, y in inner) else max(y for _, y in inner)
    else:
        lo, hi = sum(x for x, _ in inner), None if any(y is None for _, y in inner) else sum(y for _, y in inner)
    a, b = node.repeat
    return lo * a, None if hi is None or b is None else hi * b


def _code_regex(node, classes: dict[Word, str]) -> str:
    if isinstance(node, Word):
        return classes[node]
    inner = ("|" if node.either else "").join(_code_regex(x, classes) for x in node.items)
    a, b = node.repeat
    return f"(?:{inner})" + ("" if (a, b) == (1, 1) else "{%d,%s}" % (a, "" if b is None else b))


def letters(words: Column, pattern: Group) -> Column:
    """A letter per word: which of the pattern's word tests it passes."""
    kinds = list(dict.fromkeys(_words(pattern)))
    number = lambda w: reduce(lambda x, y: x + y, [F.when(word_test(k, w), 1 << i).otherwise(0) for i, k in enumerate(kinds)])
    return F.array_join(F.transform(words, lambda w: F.substring(F.lit(LETTERS), number(w) + 1, F.lit(1))), "")


def _regexes(pattern: Group) -> tuple[str, str]:
    """(regular expression of the pattern over letters, a class of the letters that any of its words can have)."""
    kinds = list(dict.fromkeys(_words(pattern)))
    if len(kinds) > 5:
        raise ValueError("more than five different words: use the matcher")
    size = 1 << len(kinds)
    classes = {w: "[" + "".join(LETTERS[m] for m in range(size) if m >> k & 1) + "]" for k, w in enumerate(kinds)}
    return _code_regex(pattern, classes), "[" + "".join(LETTERS[1:size]) + "]"


MARK = "\x01"


def spans(words: Column, pattern: Group, code: Column | None = None, mode: str = "All") -> Column:
    """ARRAY<STRUCT<s, e>> of the full matches of a plain pattern, e exclusive: all of them, longest first for each start,
    or the Longest or the Shortest of each start.

    One pass of a look-ahead marks the places where a match begins; only from there on are ends looked for. words and code
    should be columns of their own, as they are used for every place.
    """
    regex, used = _regexes(pattern)
    code = letters(words, pattern) if code is None else code
    lo, hi = _bounds(pattern)
    lo = max(lo, 1)
    none = F.array().cast("array<int>")
    if pattern.anchor_start:
        starts = F.when(code.rlike(f"^(?:{regex})"), F.array(F.lit(0))).otherwise(none)
    else:
        marked = F.regexp_replace(code, f"(?=(?:{regex})).", MARK)
        starts = F.filter(F.transform(F.split(marked, ""), lambda c, k: F.when(c == MARK, k)), lambda k: k.isNotNull())

    def ends(start: Column) -> Column:
        if lo == hi:
            hits = F.array(F.lit(lo))
        else:
            run = F.length(F.regexp_extract(F.substring(code, start + 1, F.length(code)), f"^{used}+", 0))
            most = run if hi is None else F.least(run, F.lit(hi))
            lengths = F.when(most >= lo, F.sequence(most, F.lit(lo), F.lit(-1))).otherwise(none)
            hits = F.filter(lengths, lambda n: F.rlike(F.substring(code, start + 1, n), F.lit(f"^(?:{regex})$")))
        if pattern.anchor_end:
            hits = F.filter(hits, lambda n: start + n == F.length(code))
        if mode != "All":
            hits = F.slice(hits, F.lit(1), F.lit(1)) if mode == "Longest" else F.slice(F.reverse(hits), F.lit(1), F.lit(1))
        return F.transform(hits, lambda n: F.struct(start.alias("s"), (start + n).alias("e")))

    return F.flatten(F.transform(starts, ends))


def apart(found: Column) -> Column:
    """The spans, one per start, that don't overlap, from the left."""
    kind = "struct<kept:array<struct<s:int,e:int>>,free:int>"
    begin = F.struct(F.array().cast("array<struct<s:int,e:int>>").alias("kept"), F.lit(0).alias("free")).cast(kind)

    def step(a: Column, x: Column) -> Column:
        ok = x["s"] >= a["free"]
        return F.struct(F.when(ok, F.concat(a["kept"], F.array(x))).otherwise(a["kept"]).alias("kept"), F.when(ok, x["e"]).otherwise(a["free"]).alias("free")).cast(kind)

    return F.aggregate(found, begin, step, lambda a: a["kept"])


def match(sents: DataFrame, patterns: list[Group], mode: str = "All", overlapping: bool = True, id_order: list[str] | None = None) -> DataFrame:
    """(doc_id, sent, corpus, pattern, places, words) of every match."""
    if mode == "All" and not overlapping:
        raise ValueError("all matches overlap")
    out = None
    for k, p in enumerate(patterns):
        if _plain(p) and not id_order and len(set(_words(p))) <= 5:
            # the letters, then the spans, each as a column of its own: inlined, they would be made anew for every start
            coded = sents.select("doc_id", "sent", "corpus", "words", F.explode(F.array(letters(F.col("words"), p))).alias("code")).where(F.col("code").rlike(_regexes(p)[0]))
            found = spans(F.col("words"), p, F.col("code"), mode)
            spanned = coded.select("doc_id", "sent", "corpus", "words", F.explode(found if overlapping else apart(found)).alias("m"))
            one = spanned.select("doc_id", "sent", "corpus", F.lit(k).alias("pattern"), F.sequence("m.s", F.col("m.e") - 1).alias("places"), F.slice("words", F.col("m.s") + 1, F.col("m.e") - F.col("m.s")).alias("words"))
        else:
            one = _walk(sents, p, k, mode, overlapping, id_order)
        out = one if out is None else out.unionByName(one)
    return out


# the matcher -------------------------------------------------------------------------------------------------------


def _passes(w: Word, word: dict) -> bool:
    ok = all(word.get(a) is not None and re.match("(?s)" + _regex(v), word[a]) for a, v in w.attrs if not v.startswith("back:"))
    return ok and not any(word.get(a) is not None and re.match("(?s)" + _regex(v)[:-1], word[a]) for g in w.neg for a, v in g)


def _heads(word: dict) -> list[tuple[str, int]]:
    return [(r, int(h) - 1) for r, _, h in (x.partition(":") for x in (word.get("syn") or "").split(";")) if h.isdigit()]


def _steps(node, words: list[dict], at: int, state: tuple) -> Iterator[tuple[int, tuple]]:
    """(place behind, state) of every way to match; state: (kept places, names, dependencies still open)."""
    kept, names, open_ = state
    if isinstance(node, Back):
        other = names.get(node.name)
        if other is not None:
            n = len(other)
            key = lambda k: tuple(words[k].get(a) for a in ATTRS[:3])
            if at + n <= len(words) and all(key(at + j) == key(o) for j, o in enumerate(other)):
                yield at + n, (kept + tuple(range(at, at + n)), names, open_)
        return
    if isinstance(node, Word):
        if at >= len(words) or not _passes(node, words[at]):
            return
        for a, v in node.attrs:
            if v.startswith("back:"):
                name, _, other = v[5:].rpartition(".")
                if name not in names or words[names[name][0]].get(other) != words[at].get(a):
                    return
        if node.name:
            for rel, frm in open_.get(node.name, ()):  # an earlier word depends on this one
                if (rel, at) not in _heads(words[frm]):
                    return
            names = {**names, node.name: (at,)}
        if node.syndep:
            rel, _, name = node.syndep.partition(":")
            if name in names:
                if (rel, names[name][0]) not in _heads(words[at]):
                    return
            else:
                open_ = {**open_, name: (*open_.get(name, ()), (rel, at))}
        yield at + 1, ((*kept, at), names, open_)
        return
    lo, hi = node.repeat

    def once(at: int, state: tuple) -> Iterator[tuple[int, tuple]]:
        if node.either:
            for x in node.items:
                yield from _steps(x, words, at, state)
            return
        todo = [(0, at, state)]
        while todo:
            k, p, s = todo.pop()
            if k == len(node.items):
                yield p, s
            else:
                todo += [(k + 1, q, t) for q, t in reversed(list(_steps(node.items[k], words, p, s)))]

    def times(n: int, at: int, state: tuple) -> Iterator[tuple[int, tuple]]:
        if hi is None or n < hi:
            for p, s in once(at, state):
                if p > at:
                    yield from times(n + 1, p, s)
        if n >= lo:
            yield at, state

    for p, (k2, names2, open2) in times(0, at, state):
        if node.name:
            names2 = {**names2, node.name: k2[len(kept) :]}
        yield p, (kept if node.ignore else k2, names2, open2)


def matches(pattern: Group, words: list[dict], mode: str = "All", overlapping: bool = True, id_order: list[str] | None = None, begins: Callable[[list[dict]], Iterable[int]] | None = None) -> list[Span]:
    """Matches from every place on, or from those that begins() names."""
    out: list[Span] = []
    free = 0
    for start in range(len(words)) if begins is None else begins(words):
        if start < free or pattern.anchor_start and start:
            continue
        ends: dict[int, Span] = {}
        for e, (kept, names, open_) in _steps(pattern, words, start, ((), {}, {})):
            if e > start and kept and e not in ends and not (pattern.anchor_end and e < len(words)) and all(n in names for n in open_):
                places = kept
                if id_order:
                    named = [names.get(n, ()) if n != "*" else None for n in id_order]
                    used = {p for x in named if x for p in x}
                    places = tuple(p for x in named for p in (x if x is not None else [p for p in kept if p not in used]))
                ends[e] = Span(places, start, e, names)
        if ends:
            order = sorted(ends, reverse=True)
            picked = order if mode == "All" else order[:1] if mode == "Longest" else order[-1:]
            out += [ends[e] for e in picked]
            if not overlapping:
                free = start + len(ends[picked[-1]].places)
    return out


def _needed(node) -> list[Word]:
    """Words that every match has, by tests that need no other word."""
    if isinstance(node, Word):
        return [Word(tuple(x for x in node.attrs if not x[1].startswith("back:")), node.neg)]
    if isinstance(node, Back) or node.either or not node.repeat[0]:
        return []
    return [w for x in node.items for w in _needed(x)]


def _relaxed(node) -> tuple[str, list[Word]] | None:
    """A regular expression over words, {k} for the k-th of the tests, that every match of a pattern has at its beginning:
    the pattern with what needs no other word of each test, and any words where a group comes again."""
    tests: list[Word] = []

    def build(node) -> str:
        if isinstance(node, Back):
            return ".*"
        if isinstance(node, Word):
            test = Word(tuple(x for x in node.attrs if not x[1].startswith("back:")), node.neg)
            if test not in tests:
                tests.append(test)
            return f"{{{tests.index(test)}}}"
        inner = ("|" if node.either else "").join(map(build, node.items))
        a, b = node.repeat
        return f"(?:{inner})" + ("" if (a, b) == (1, 1) else "{{%d,%s}}" % (a, "" if b is None else b))

    out = build(node)
    return (out, tests) if len(tests) <= 5 else None


class Begins:
    """Where a match may begin, by one letter per word and a regular expression; tests are made once per different word."""

    def __init__(self, pattern: Group):
        found = _relaxed(pattern)
        self.tests = found[1] if found else []
        classes = ["[" + "".join(LETTERS[m] for m in range(1 << len(self.tests)) if m >> k & 1) + "]" for k in range(len(self.tests))]
        self.regex = re.compile(f"(?=(?:{found[0].format(*classes)}))") if found else None
        # attributes that the tests look at, and those words that were seen
        self.used = tuple(dict.fromkeys(a for t in self.tests for a, _ in [*t.attrs, *[x for g in t.neg for x in g]]))

    def letter(self, word: dict) -> str:
        return LETTERS[sum(1 << k for k, t in enumerate(self.tests) if _passes(t, word))]

    def at(self, code: str) -> list[int]:
        return [m.start() for m in self.regex.finditer(code) if m.start() < len(code)]

    def __call__(self, words: list[dict]) -> list[int] | range:
        return range(len(words)) if self.regex is None else self.at("".join(map(self.letter, words)))

    def codes(self, words: pa.StructArray) -> str:
        """A letter for each of the words of a batch."""
        number = np.zeros(len(words), np.int64)
        have = [words.type.field(k).name for k in range(words.type.num_fields)]
        columns = {a: c for a, c in zip(have, words.flatten(), strict=True) if a in self.used}
        for c in columns.values():
            coded = c.dictionary_encode(null_encoding="encode")
            number = pd.factorize(number * max(1, len(coded.dictionary)) + coded.indices.to_numpy(zero_copy_only=False))[0]
        first = np.zeros(number.max() + 1 if len(number) else 0, np.int64)
        first[number[::-1]] = np.arange(len(number))[::-1]
        different = {a: c.take(pa.array(first)).to_pylist() for a, c in columns.items()}
        table = [ord(self.letter({a: v[k] for a, v in different.items()})) for k in range(len(first))]
        return np.array(table, np.uint8)[number].tobytes().decode() if table else ""


class Own:
    """Words `first` to `first + size` of columns, as dicts made where they are looked at."""

    def __init__(self, columns: dict[str, list], first: int, size: int):
        self.columns, self.first, self.size = columns, first, size

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, k: int) -> dict:
        return {a: c[self.first + k] for a, c in self.columns.items()}


def _some(need: Word) -> Column:
    return F.exists("words", lambda w: word_test(need, w))


def _walk(sents: DataFrame, pattern: Group, number: int, mode: str, overlapping: bool, id_order: list[str] | None) -> DataFrame:
    """Matches by the matcher in Python; only sentences that have every word that a match needs are sent there."""
    word = sents.schema["words"].dataType.elementType.simpleString()
    for need in dict.fromkeys(w for w in _needed(pattern) if w.attrs or w.neg):
        sents = sents.where(_some(need))

    kinds = [f.name for f in sents.schema["words"].dataType.elementType.fields]
    places = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins = Begins(pattern)
        for b in batches:
            words = b.column("words")
            sizes = pc.fill_null(pc.list_value_length(words), 0).to_pylist()
            flat = words.flatten()
            code = None if begins.regex is None else begins.codes(flat)
            columns = {a: c.to_pylist() for a, c in zip(kinds, flat.flatten(), strict=True)}
            at, found, kept, behind = [], [], [], 0
            for k, n in enumerate(sizes):
                starts = range(n) if code is None else begins.at(code[behind : behind + n])
                for m in matches(pattern, Own(columns, behind, n), mode, overlapping, id_order, lambda _, starts=starts: starts) if starts else ():
                    at.append(k)
                    found.append(m.places)
                    kept += [behind + p for p in m.places]
                behind += n
            own = pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, found))], pa.int32()), flat.take(pa.array(kept, pa.int64())))
            same = [b.column(c).take(pa.array(at, pa.int64())) for c in ("doc_id", "sent", "corpus")]
            yield pa.RecordBatch.from_arrays([*same, pa.array([number] * len(at), pa.int32()), pa.array(found, places), own], ["doc_id", "sent", "corpus", "pattern", "places", "words"])

    return sents.select("doc_id", "sent", "corpus", "words").mapInArrow(run, f"doc_id long, sent long, corpus string, pattern int, places array<int>, words array<{word}>")


def grep(sents: DataFrame, patterns: list[Group], only_matching: bool = False, annotate: bool = False) -> DataFrame:
    """Sentences with a match; only_matching: the matches themselves, as sentences; annotate: with `occs`, the places of
    each match."""
    found = match(sents, patterns)
    if only_matching:
        return found.select("doc_id", "sent", "corpus", "words", "places")
    hits = found.groupBy("doc_id", "sent").agg(*([F.array_sort(F.collect_set("places")).alias("occs")] if annotate else []), F.count("*").alias("hits"))
    return sents.join(hits, ["doc_id", "sent"])


def whole(cands: DataFrame, patterns: list[Group]) -> DataFrame:
    """Entities (words, any other columns) that a pattern matches from the first to the last word: `pattern`, the number of
    the first such, and `matched`, the words that it keeps. Plain patterns are tested in the row."""
    if all(_plain(p) and len(set(_words(p))) <= 5 for p in patterns):
        first = F.coalesce(*[F.when(letters(F.col("words"), p).rlike(f"^(?:{_regexes(p)[0]})$"), k) for k, p in enumerate(patterns)])
        return cands.withColumn("pattern", first).where("pattern is not null").withColumn("matched", F.col("words"))
    from phrasemill.model import stored

    keyed = stored(cands.withColumn("doc_id", F.monotonically_increasing_id()).withColumn("sent", F.lit(0).cast("long")).withColumn("corpus", F.lit("")), "entities")
    found = match(keyed, [replace(p, anchor_start=True, anchor_end=True) for p in patterns], "Longest")
    first = found.groupBy("doc_id").agg(F.min_by(F.struct("pattern", F.col("words").alias("matched")), "pattern").alias("m"))
    return keyed.join(first, "doc_id").select(*[F.col(f"`{c}`") for c in cands.columns], "m.pattern", "m.matched")


def to_xml(patterns: list[Group]) -> str:
    """The document that parse() reads as these patterns."""

    def build(node, into: ET.Element) -> None:
        if isinstance(node, Back):
            ET.SubElement(into, "backpat", id=node.name)
        elif isinstance(node, Word):
            e = ET.SubElement(into, "w", {**dict(node.attrs), **({"id": node.name} if node.name else {}), **({"syndep": node.syndep} if node.syndep else {})})
            for n in node.neg:
                ET.SubElement(e, "neg", dict(n))
        else:
            lo, hi = node.repeat
            attrs = {"repeat": "{%d,%s}" % (lo, "" if hi is None else hi)} if node.repeat != (1, 1) else {}
            attrs |= {k: "true" for k in ("ignore", "anchor_start", "anchor_end") if getattr(node, k)} | ({"id": node.name} if node.name else {})
            e = ET.SubElement(into, "either" if node.either else "pat", attrs)
            for x in node.items:
                build(x, e)

    root = ET.Element("patterns")
    for p in patterns:
        build(p, root)
    return ET.tostring(root, encoding="unicode")
