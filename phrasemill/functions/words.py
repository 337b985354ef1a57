"""Scalar functions of words and word lists (struct columns surface, lemma, pos)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lemma_or_surface(w: Column) -> Column:
    return F.coalesce(w["lemma"], w["surface"])


def word_length(w: Column) -> Column:
    """Letters of the first defined attribute."""
    return F.coalesce(F.length(w["surface"]), F.length(w["lemma"]), F.length(w["pos"]), F.lit(0))


def case_class(form: Column) -> Column:
    """lowercase, UPPERCASE, Firstupper, MiXeD, or ? without letters."""
    upper, lower = form.rlike(r"\p{Lu}"), form.rlike(r"\p{Ll}")
    return F.when(~upper & ~lower, "?").when(~upper, "lowercase").when(~lower, "UPPERCASE").when(form.rlike(r"^\p{Lu}\p{Ll}[^\p{Lu}]*$"), "Firstupper").otherwise("MiXeD")


def pos_pattern(words: Column, sep: str = "-") -> Column:
    return F.array_join(F.transform(words, lambda w: w["pos"]), sep)


def set_all(words: Column, **values: str | None) -> Column:
    """Every word with the given attributes replaced; None undefines one."""
    def change(w: Column) -> Column:
        for name, v in values.items():
            w = w.withField(name, F.lit(v).cast("string"))
        return w

    return F.transform(words, change)


def parse_syn(syn: Column) -> Column:
    """'rel:head;rel:head' as pairs with heads from 0; malformed parts are left out."""
    parts = F.filter(F.split(syn, ";"), lambda p: p.rlike(r"^[^:]*:[0-9]+$"))
    return F.transform(parts, lambda p: F.struct(F.split_part(p, F.lit(":"), F.lit(1)).alias("rel"), (F.split_part(p, F.lit(":"), F.lit(2)).cast("int") - 1).alias("head")))


def encode_syn(pairs: Column) -> Column:
    return F.array_join(F.transform(pairs, lambda p: F.concat(p["rel"], F.lit(":"), (p["head"] + 1).cast("string"))), ";")


def source_string(sent_id: Column, places: Column) -> Column:
    """'sentence:w1,w2' with places from 1."""
    return F.concat(sent_id.cast("string"), F.lit(":"), F.array_join(F.transform(places, lambda k: (k + 1).cast("string")), ","))


def parse_source(source: Column) -> Column:
    return F.struct(F.split_part(source, F.lit(":"), F.lit(1)).cast("long").alias("sent_id"), F.transform(F.split(F.split_part(source, F.lit(":"), F.lit(2)), ","), lambda k: k.cast("int") - 1).alias("places"))


def find(words: Column, part: Column) -> Column:
    """Places (from 0) at which part occurs as a run, without overlaps, from the left."""
    n = F.size(part)
    start = F.struct(F.array().cast("array<int>").alias("found"), F.lit(0).alias("free"))

    def step(acc: Column, k: Column) -> Column:
        hit = (k >= acc["free"]) & (F.slice(words, k + 1, n) == part)
        return F.struct(F.when(hit, F.concat(acc["found"], F.array(k))).otherwise(acc["found"]).alias("found"), F.when(hit, k + n).otherwise(acc["free"]).alias("free"))

    return F.when((n > 0) & (F.size(words) >= n), F.aggregate(F.sequence(F.lit(0), F.size(words) - n), start, step, lambda a: a["found"])).otherwise(F.array().cast("array<int>"))


def sub_sentence(words: Column, kept: Column, occs: Column | None = None) -> Column:
    """STRUCT<words, occs> of the words at the places kept (in order): heads (syn) are the new places, 0 where the head is
    gone; occurrences (arrays of places) that lost a word go."""
    new = lambda k: (F.array_position(kept, k) - 1).cast("int")  # noqa: E731 - -1: gone

    def moved(w: Column) -> Column:
        return w.withField("syn", encode_syn(F.transform(parse_syn(w["syn"]), lambda p: F.struct(p["rel"].alias("rel"), new(p["head"]).alias("head")))))

    left = F.transform(kept, lambda k: moved(F.get(words, k)))
    whole = F.array().cast("array<array<int>>") if occs is None else F.transform(F.filter(occs, lambda o: F.forall(o, lambda k: F.array_contains(kept, k))), lambda o: F.transform(o, new))
    return F.struct(left.alias("words"), whole.alias("occs"))


def groups(size: Column, occs: Column) -> Column:
    """ARRAY<ARRAY<INT>>: the places of each single word or unit; a unit (an array of places in occs) stands at its first
    place, and takes what is at its others."""
    each = F.when(size > 0, F.transform(F.sequence(F.lit(0), size - 1), lambda k: F.array(k))).otherwise(F.array().cast("array<array<int>>"))

    def joined(g: Column, o: Column) -> Column:
        rest = F.flatten(F.transform(F.filter(o, lambda i: i != F.array_min(o)), lambda i: F.get(g, i)))
        return F.transform(g, lambda x, j: F.when(j == F.array_min(o), F.concat(x, rest)).when(F.array_contains(o, j), F.array().cast("array<int>")).otherwise(x))

    return F.filter(F.aggregate(occs, each, joined), lambda x: F.size(x) > 0)


_CODED = {"pipe": "|", "hash": "#", "underscore": "_", "space": " ", "tab": "\t", "newline": "\n", "slash": "/", "semicolon": ";", "lt": "<", "gt": ">"}
ESCAPES = {
    "conll": ("underscore", "space", "hash", "tab", "newline"), "moses": ("pipe", "hash", "space", "tab", "newline"), "plaincorpus": ("space", "tab", "underscore", "hash", "newline"),
    "csv": ("slash", "space", "semicolon", "tab", "newline", "hash"), "ucs": ("slash", "space", "tab", "newline", "hash"), "treetagger": ("pipe", "hash", "lt", "gt", "space", "tab", "newline"),
    "pwac": ("underscore", "lt", "gt", "space", "hash", "tab", "newline"), "taggedplaincorpus": ("hash", "lt", "gt", "space", "newline"),
}


def escape(x: Column, fmt: str) -> Column:
    """Letters with a meaning in a format as ${name}; the escape sign itself first."""
    x = F.replace(x, F.lit("$"), F.lit("${dollar}"))
    for name in ESCAPES[fmt]:
        x = F.replace(x, F.lit(_CODED[name]), F.lit("${%s}" % name))
    return x


def unescape(x: Column, fmt: str) -> Column:
    for name in reversed(ESCAPES[fmt]):
        x = F.replace(x, F.lit("${%s}" % name), F.lit(_CODED[name]))
    return F.replace(x, F.lit("${dollar}"), F.lit("$"))


# parts of speech -------------------------------------------------------------------------------------------------

_PTB_REST = {"V": "MD", "P": "IN TO RP EX", "DT": "CT XT", "NUM": "CD", "PP": "POS", "FW": "FW", "PCT": "SYM LS `` '' SENT", "UH": "UH"}
_PALAVRAS = {"A": "ADJ", "R": "ADV", "P": "IN PRP", "DT": "DET", "PP": "SPEC PERS", "CC": "KS KC", "FW": "EC", "N": "PROP"}
_GENIA = {
    "N": "NN NNS NNP NNPS NP NPS NN|NNS NN|DT NN|CD NNS|FW JJ|NN VBG|NN", "A": "JJ JJR JJS JJ|VBG JJ|RB JJ|NNS JJ|VBN VBG|JJ", "R": "RB RBR RBS WRB", "FW": "FW", "NUM": "CD", "CC": "CC CCS",
    "V": "VB VBD VBG VBN VBP VBZ VV VVD VVG VVN VVP VVZ VH VHD VHG VHN VHP VHZ MD VBP|VBZ VBN|JJ VBD|VBN", "P": "IN TO RP EX IN|PRP$ IN|CC", "DT": "DT PDT WDT CT XT",
    "PP": "PRP PRP$ PP PP$ WP WP$ POS", "PCT": "SYM LS . , : \" ( ) ' ? - / `` ''",
}


def _by_list(x: Column, table: dict[str, str], otherwise: Column) -> Column:
    c = None
    for tag, members in table.items():
        hit = x.isin(*members.split(" "))
        c = F.when(hit, tag) if c is None else c.when(hit, tag)
    return c.otherwise(otherwise)


def simplify_ptb(pos: Column) -> Column:
    first = F.split_part(pos, F.lit("|"), F.lit(1))
    sign = F.instr(F.lit("\"()':?-/$.,"), first) > 0
    return (
        F.when(first.startswith("N"), "N").when(first.startswith("V"), "V").when(first.startswith("J"), "A").when(first.contains("RB"), "R").when(first.contains("DT"), "DT").when(first.contains("CC"), "CC")
        .when(first.rlike("^(PRP|PP|WP)"), "PP").when((first != "") & sign, "PCT").otherwise(_by_list(first, _PTB_REST, first))
    )


def simplify_palavras(pos: Column) -> Column:
    first = F.split_part(pos, F.lit("|"), F.lit(1))
    return F.when(pos.isin("N", "V", "PCT", "NUM"), pos).when(pos.rlike("[->]"), "UKN").otherwise(_by_list(first, _PALAVRAS, first))


def simplify_genia(pos: Column) -> Column:
    return _by_list(pos, _GENIA, pos)


CONTENT = ("CD", "JJ", "JJR", "JJS", "NN", "NNS", "NP", "NPS", "RB", "RBR", "RBS", "RP", "VV", "VVD", "VVG", "VVN", "VVP", "VVZ")
STANDS_FOR = ("CD", "NP", "NPS")


def content_words(words: Column, allowed: tuple[str, ...] = CONTENT, kept_places: Column | None = None, lemma_regex: str | None = None, stands_for: tuple[str, ...] = STANDS_FOR, with_pos: bool = False) -> Column:
    """Words with an allowed tag, or in a multiword unit (kept_places); some are replaced by a placeholder of their tag."""
    def ok(w: Column, k: Column) -> Column:
        c = w["pos"].isin(*allowed)
        if lemma_regex:
            c = c & w["lemma"].rlike(lemma_regex)
        return c if kept_places is None else c | F.array_contains(kept_places, k)

    def show(w: Column) -> Column:
        form = F.when(w["pos"].isin(*stands_for), F.concat(F.lit("placehold"), w["pos"])).otherwise(F.coalesce(w["lemma"], w["surface"]))
        return F.concat(form, F.lit("/"), w["pos"]) if with_pos else form

    return F.transform(F.filter(words, ok), show)


def mwe_tagged(forms: Column, marks: Column) -> Column:
    """Forms with <mwepart id="..">: marks has, per word, the ids of its units (possibly none)."""
    return F.array_join(F.zip_with(forms, marks, lambda f, m: F.when(F.size(m) > 0, F.concat(F.lit('<mwepart id="'), F.array_join(m.cast("array<string>"), ","), F.lit('">'), f, F.lit("</mwepart>"))).otherwise(f)), " ")


def singular(surface: Column, pos: Column) -> Column:
    """The regular singular that an English noun's plural suggests; null if none does."""
    n = F.length(surface)
    plural = surface.endswith("s") & (pos == "N") & (n > 2) & ~surface.rlike("(ss|is|us)$")
    return F.when(plural, F.when(surface.endswith("ies"), F.concat(F.left(surface, n - 3), F.lit("y"))).when(surface.endswith("oes"), F.left(surface, n - 2)).otherwise(F.left(surface, n - 1)))
