"""Reading and writing N-Triples as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The shapes of N-Triples terms. No escape names half a surrogate pair.
ESCAPED = r"\\u(?![dD][89a-fA-F])[0-9A-Fa-f]{4}|\\U(?!0000[dD][89a-fA-F])00(?:0[0-9A-Fa-f]|10)[0-9A-Fa-f]{4}"
IRI = rf'<(?:[^<>"\\\s]++|{ESCAPED})*+>'
BLANK = r'_:[^\s<>".]+(?:\.+[^\s<>".]+)*'
LITERAL = rf'"(?:[^"\\]++|\\[tbnrf"\'\\]|{ESCAPED})*+"(?:@[A-Za-z]+(?:-[A-Za-z0-9]+)*|\^\^{IRI})?'
LINE = rf"(?s)^[ \t\r\n]*({IRI}|{BLANK})\s*({IRI})\s*({IRI}|{BLANK}|{LITERAL})\s*\.\s*(?:#.*)?$"
PIECE = r"(?s)\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+"
# Characters that a literal keeps escaped, and those that an IRI may not hold as they are.
KEPT = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r"}
SHORT = {"\\t": "\t", "\\b": "\b", "\\f": "\f", "\\'": "'"}
NOT_IN_IRI = r"[\x00-\x20<>\"{}|^`\\]"


def read_ntriples(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """``(triples, rejects)`` of the files at ``paths``, folders walked to the bottom.

    Blank node names hold within one file only, so they are marked with their file.
    ``rejects`` has the lines that are no triples. Both parse the text when they are
    used; write the triples to a table before using them more than once.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(list(paths))
    scope = F.concat(F.hex(F.xxhash64("_metadata.file_path")), F.lit("."))
    return parse_ntriples(lines.select("value", scope.alias("scope")))


def parse_ntriples(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``read_ntriples``, from lines in ``value``; ``scope`` marks blank nodes if given."""
    scope = F.col("scope") if "scope" in lines.columns else F.lit("")
    # One match of the line puts its terms on lines of their own; a line that is no triple
    # stays as it is and does not begin with a line feed. As a generated row, the terms are
    # worked out once and not again in every filter. The match takes white space around the
    # triple along; empty lines and comments match nothing and are only told from rejects.
    line = F.btrim("value", F.lit(" \t\r\n"))
    text = F.when(F.col("value").startswith("\n"), line).otherwise(F.col("value"))
    terms = F.split(F.regexp_replace(text, LINE, "\n$1\n$2\n$3"), "\n", 4)
    parsed = lines.select("value", scope.alias("scope"), F.inline(F.array(F.struct(terms.alias("t")))))
    good = (F.get("t", F.lit(0)) == "") & (F.size("t") == 4)
    triples = parsed.filter(good).select(
        *[_term(F.get("t", F.lit(i))).alias(n) for i, n in enumerate("spo", 1)]
    )
    said = (line != "") & ~line.startswith("#")
    rejects = parsed.filter(~good & said).select(F.col("value").alias("line"))
    return triples, rejects


def _term(term: Column) -> Column:
    named = _decoded(F.substring(term, F.lit(2), F.length(term) - 2), literal=False)
    return (
        F.when(term.startswith("<"), named)
        .when(term.startswith("_:"), F.concat(F.lit("_:"), F.col("scope"), F.substr(term, F.lit(3))))
        .otherwise(_decoded(term, literal=True))
    )


def _decoded(text: Column, literal: bool) -> Column:
    """``text`` with its escapes decoded, so that a term is spelt in one way.

    In a literal, quotes, backslashes and line ends stay escaped, and only they are.
    """

    def piece(part: Column) -> Column:
        digits = F.unhex(F.substr(part, F.lit(3)))
        sign = F.when(part.startswith("\\u"), F.decode(digits, "UTF-16BE")).when(
            part.startswith("\\U"), F.decode(digits, "UTF-32")
        )
        if not literal:
            return F.coalesce(sign, part)
        short = F.create_map([F.lit(x) for pair in SHORT.items() for x in pair])
        kept = F.create_map([F.lit(x) for pair in KEPT.items() for x in pair])
        return F.coalesce(F.try_element_at(kept, sign), sign, F.try_element_at(short, part), part)

    pieces = F.regexp_extract_all(text, F.lit(PIECE), 0)
    whole = F.array_join(F.transform(pieces, piece), "")
    return F.when(F.contains(text, F.lit("\\")), whole).otherwise(text)


def format_ntriples(triples: DataFrame) -> DataFrame:
    """One N-Triples line per triple, in column ``value``."""

    def named(iri: Column) -> Column:
        signs = F.regexp_extract_all(iri, F.lit(rf"(?s){NOT_IN_IRI}|[^\x00-\x20<>\"{{}}|^`\\]+"), 0)
        coded = F.transform(
            signs,
            lambda x: F.when(
                x.rlike(NOT_IN_IRI), F.concat(F.lit("\\u"), F.hex(F.encode(x, "UTF-16BE")))
            ).otherwise(x),
        )
        safe = F.when(iri.rlike(NOT_IN_IRI), F.array_join(coded, "")).otherwise(iri)
        return F.concat(F.lit("<"), safe, F.lit(">"))

    terms = [
        F.when(F.col(c).startswith("_:") | F.col(c).startswith('"'), F.col(c)).otherwise(
            named(F.col(c))
        )
        for c in ("s", "p", "o")
    ]
    return triples.select(F.concat_ws(" ", *terms, F.lit(".")).alias("value"))


def write_answers(answers: DataFrame, path: str) -> None:
    """Save query answers as text, columns split by tabs; one file per task."""
    line = F.concat_ws("\t", *[F.col(c) for c in answers.columns])
    answers.select(line.alias("value")).write.mode("overwrite").text(path)
