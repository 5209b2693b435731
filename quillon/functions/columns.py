"""Column expressions that the operators share; all are built-in functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.schema import BY_EXTENSION, BY_NAME, TIERS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: str | Column) -> Column:
    """A-Z in lower case; lower() would change other letters too."""
    return F.translate(text, UPPER, LOWER)


def byte_levenshtein(a: Column, b: Column) -> Column:
    """Edit distance over UTF-8 bytes: over code points of their Latin-1 reading."""
    as_bytes = lambda c: F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")
    return F.levenshtein(as_bytes(a), as_bytes(b)).cast("long")


def tier(kind: str | Column) -> Column:
    kind = F.col(kind) if isinstance(kind, str) else kind
    out = F.lit(10)
    for score, kinds in TIERS.items():
        out = F.when(kind.isin(kinds.split()), score).otherwise(out)
    return out


def path_penalty(path: Column) -> Column:
    low = ascii_lower(path)
    has = lambda *parts: F.greatest(*[low.contains(p) for p in parts], F.lit(False))
    depth = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))) - 6
    return (
        F.when(has("/test/", "/tests/", "/testing/"), 25).otherwise(0)
        + F.when(has("/sample", "/example"), 15).otherwise(0)
        + F.when(has("/generated/", "/gen/", ".pb.", "_pb2."), 20).otherwise(0)
        + F.least(F.greatest(depth, F.lit(0)), F.lit(8))
    )


def rank_score() -> Column:
    """Of the columns kind, lang, scope_path and path."""
    scope = F.least(F.size("scope_path"), F.lit(10)) * 3
    return (tier("kind") - F.when(F.col("lang") == "ApiTxt", 40).otherwise(0) - scope - path_penalty(F.col("path"))).cast("long")


def path_filter(path: Column, inside: str | None = None, outside: str | None = None) -> Column:
    ok = F.lit(True)
    if inside:
        ok = ok & path.contains(inside)
    return ok & ~path.contains(outside) if outside else ok


def same_word(column: str, value: str | None) -> Column:
    """Equality that ignores ASCII case; true for everything without a value."""
    return ascii_lower(F.col(column)) == value.lower() if value else F.lit(True)


def subsequence(name: Column, query: str) -> Column:
    """The query's characters in the name, in order, without regard to ASCII case."""
    return ascii_lower(name).rlike("(?s)" + ".*".join(re.escape(c) for c in query.translate(str.maketrans(UPPER, LOWER))))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def _lookup(kinds: dict[str, str], key: Column) -> Column:
    """The kind whose words hold the key; one constant map, however many kinds there are."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kind, words in kinds.items() for word in words.split() for x in (word, kind)]), key)


def classify(path: Column) -> Column:
    """The file kind, null if none: exact name, Kconfig, text below a folder `api`, then extension."""
    name = base_name(path)
    extension = F.when(name.rlike(r"^.+\.[^.]*$"), ascii_lower(F.substring_index(name, ".", -1)))
    return F.coalesce(
        _lookup(BY_NAME, name),
        F.when(name.rlike(r"^Kconfig([.-].*)?$"), "Kconfig"),
        F.when(path.rlike(r"(^|/)api/[^/]+\.txt$"), "ApiTxt"),
        _lookup(BY_EXTENSION, F.coalesce(extension, F.lit(""))),
    )


def looks_binary(content: Column) -> Column:
    """NUL in the first 512 bytes, or control bytes in more than a tenth of them."""
    head = F.decode(F.substring(content, 1, 512), "ISO-8859-1")
    odd = F.length(F.regexp_replace(head, r"[^\x01-\x08\x0b\x0c\x0e-\x1f\x7f]", ""))
    return F.contains(head, F.lit("\x00")) | (odd * 10 > F.length(head))


def symbol_id(*parts: Column) -> Column:
    return F.substr(F.sha2(F.concat_ws("|", *parts), 256), F.lit(1), F.lit(16))


def fqn_index(scope: Column, name: Column) -> Column:
    """Scope and name joined by ::, null without a scope."""
    return F.when(F.size(scope) > 0, F.array_join(F.concat(scope, F.array(name)), "::"))


def fqn_live(package: Column, scope: Column, name: Column, lang: Column) -> Column:
    """Package, scope and name, joined by :: for C, C++ and Rust and by a dot else."""
    parts = F.concat(F.filter(F.array(package), lambda p: p.isNotNull()), scope, F.array(name))
    return F.when(lang.isin("C", "Cpp", "Header", "HeaderCpp", "Rust"), F.array_join(parts, "::")).otherwise(F.array_join(parts, "."))


def jni_mangle(name: Column, package: bool = False) -> Column:
    """The name as part of a JNI symbol; a package's dots become underscores."""
    out = F.replace(name, F.lit("_"), F.lit("_1"))
    for plain, put in ((";", "_2"), ("[", "_3"), ("$", "_00024")):
        out = F.replace(out, F.lit(plain), F.lit(put))
    return F.replace(out, F.lit("."), F.lit("_")) if package else out


def quoted(text: str) -> str:
    """A Java regular expression for exactly this text."""
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|#&~" else c for c in text)
