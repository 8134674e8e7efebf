"""Text functions as Column expressions: all of them stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space of Unicode, abbreviations whose point ends no sentence, marks of compound claims.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
ABBREVIATIONS = ["Mr", "Mrs", "Ms", "Dr", "Prof", "Sr", "Jr", "vs", "etc"]
COMPOUND = [", and ", ", but ", ", while ", ", whereas ", ", although ", ", which ", ", who ", ", where ", "; ", " — ", " – "]
STRIPPED = ".!?,;:\"'"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: After a mark that ends a sentence: not a point between digits, nor one behind an abbreviation.
SENTENCE_END = rf"(?<=[.!?;])(?!(?<=[0-9][.])[0-9])(?<!(?:{'|'.join(ABBREVIATIONS)})[.])"


def trimmed(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.btrim(text, F.lit(WHITE))


def collapsed(text: Column) -> Column:
    """Each run of Unicode white space made one blank."""
    return F.regexp_replace(text, r"(?U)\s++", " ")


def raw_pieces(text: Column) -> Column:
    """The text cut after each sentence mark. Cuts have no width, so pieces are the text's own characters."""
    return F.array_remove(F.split(text, SENTENCE_END, -1), "")


def sentences(text: Column) -> Column:
    """The sentences of a text, in order."""
    return F.array_remove(F.transform(raw_pieces(text), trimmed), "")


def normalized(text: Column) -> Column:
    """Lower case, white space collapsed, marks stripped from both ends: what verbatim containment compares."""
    return F.btrim(F.btrim(collapsed(F.lower(text)), F.lit(" ")), F.lit(STRIPPED))


def is_compound(text: Column) -> Column:
    """True where the text holds a mark that joins several facts."""
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(m)) for m in COMPOUND))


def adaptive_k(text: Column, k: Column | int, adaptive: bool = True) -> Column:
    """Candidates for a claim of this length: one for every 40 characters, 3 to k; k itself if not adaptive or 0."""
    k = F.lit(k) if isinstance(k, int) else k
    if not adaptive:
        return k
    return F.when(k == 0, k).otherwise(F.least(F.greatest(F.ceil(F.length(text) / 40).cast("int"), F.lit(3)), k))


def letter_vector(text: Column) -> Column:
    """How often each of a-z occurs: a deterministic embedding for tests and offline runs."""
    low = F.lower(text)
    return F.array(*[(F.octet_length(low) - F.octet_length(F.replace(low, F.lit(c), F.lit("")))).cast("double") for c in LETTERS])


def dot(a: Column, b: Column) -> Column:
    """The dot product of two arrays of one size. Unrolled it outgrows what the JVM compiles, and takes twice the time."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine of two vectors; null where one has no length."""
    na = norm_a if norm_a is not None else F.sqrt(dot(a, a))
    nb = norm_b if norm_b is not None else F.sqrt(dot(b, b))
    return F.try_divide(dot(a, b), na * nb)


def words(text: Column) -> Column:
    """Distinct lower-case words of ASCII letters and digits."""
    return F.array_distinct(F.array_remove(F.split(F.lower(text), "[^a-z0-9]+", -1), ""))


def strip_html(html: Column) -> Column:
    """Visible text of a page: tags, scripts and styles go, white space collapses."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*+>.*?</\1[^>]*+>", "")
    return F.btrim(collapsed(F.regexp_replace(bare, r"<[^>]*+>", "")), F.lit(" "))


def article_title(url: Column, host_suffix: str, prefix: str) -> Column:
    """The title in a URL of a host with this suffix whose path begins with the prefix; else null."""
    host = F.parse_url(url, F.lit("HOST"))
    path = F.regexp_extract(F.parse_url(url, F.lit("PATH")), f"^/{prefix}/([^/?#]+)", 1)
    return F.when(host.endswith(host_suffix) & (path != ""), path)


def json_depth(json: Column) -> Column:
    """Nesting depth of a JSON text: 0 for scalars, 1 for an empty container."""
    bare = F.regexp_replace(json, r'"(?:\\.|[^"\\])*+"', '""')
    brackets = F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), "")
    running = F.aggregate(
        brackets,
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda s, c: F.struct(
            (s["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)).alias("now"),
            F.greatest(s["most"], s["now"] + F.when(c.isin("[", "{"), 1).otherwise(0)).alias("most"),
        ),
    )
    return running["most"]


def input_hash(context: Column, question: Column, answer: Column) -> Column:
    """SHA-256 of the three parts joined by a vertical bar; null counts as empty."""
    parts = [F.coalesce(p, F.lit("")) for p in (context, question, answer)]
    return F.sha2(F.concat_ws("|", *parts), 256)


def json_value(json: Column, pointer: str) -> Column:
    """The variant that a JSON pointer such as /a/0 names, with its type; null where there is none or the text is no JSON.

    A number names an index of an array or a key of an object, whichever is there.
    """
    if pointer and not pointer.startswith("/"):
        return F.lit(None).cast("variant")
    paths = ["$"]
    for part in pointer.split("/")[1:]:
        name = part.replace("~1", "/").replace("~0", "~")
        mark = '"' if "'" in name else "'"
        if mark in name:
            raise ValueError(f"a key with both quotation marks: {name}")
        steps = [f"[{mark}{name}{mark}]"]
        if name.isascii() and name.isdigit() and (name == "0" or name[0] != "0"):
            steps.append(f"[{name}]")
        paths = [p + step for p in paths for step in steps]
    value = F.try_parse_json(json)
    return F.coalesce(*[F.try_variant_get(value, p, "variant") for p in paths])


def json_pointer(json: Column, pointer: str) -> Column:
    """The JSON text of what a pointer names, strings without their marks; null for JSON's null or nothing."""
    value = json_value(json, pointer)
    text = F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))
    return F.when(~F.is_variant_null(value), F.coalesce(text, F.to_json(value)))
