"""Strings, paths and names."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftmark.plans.rules import KEY_QUALIFIERS, SECRET_NAMES, SECRET_WORDS, USER_PLACEHOLDER


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once for a body that uses it often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def percent_encode(segment: Column) -> Column:
    """Each byte outside A-Za-z0-9._~- as %XX, upper-case."""
    out = F.url_encode(segment)
    for a, b in (("+", "%20"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def user_placeholder(text: Column, username: str) -> Column:
    """Username between other than ASCII letters and digits becomes a placeholder; shorter than two characters: nothing."""
    if len(username) < 2:
        return text
    return F.regexp_replace(text, rf"(?<![A-Za-z0-9])\Q{username}\E(?![A-Za-z0-9])", USER_PLACEHOLDER)


def clean_path(path: Column) -> Column:
    """Relative path without leading slash, empty and dot segments; '..' takes the segment before it, if any."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    up = lambda acc, p: F.when((p == "..") & (F.size(acc) > 0) & (F.coalesce(F.element_at(acc, -1), F.lit("")) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    return F.when(F.size(parts) == 0, F.array().cast("array<string>")).otherwise(F.aggregate(parts, F.array().cast("array<string>"), up))


def canonical_path(path: Column, username: str = "") -> Column:
    """Cleaned path, username replaced, each segment percent-encoded."""
    joined = user_placeholder(F.array_join(clean_path(path), "/"), username)
    return F.array_join(F.transform(F.split(joined, "/"), percent_encode), "/")


def username_of(path: Column) -> Column:
    return F.regexp_extract(F.translate(path, "\\", "/"), r"(?:^|/)(?:Users|home)/([^/]*)", 1)


def project_dir(path: Column) -> Column:
    """The segment after ``projects``; empty if there is none."""
    return F.regexp_extract(path, "(?:^|/)projects/([^/]+)", 1)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def key_words(key: Column) -> Column:
    """Lower-case words of a field name: separators and camel humps break words, runs of capitals stay together."""
    humps = F.regexp_replace(key, "(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_")
    return F.array_remove(F.split(F.lower(humps), "[-_. :/]+"), "")


def is_secret_key(key: Column) -> Column:
    """Does a field name say that its value is a credential: by its last word, a qualified ``key``, or a configured name?"""
    last = F.coalesce(F.try_element_at(key_words(key), F.lit(-1)), F.lit(""))
    before = F.coalesce(F.try_element_at(key_words(key), F.lit(-2)), F.lit(""))
    upper, named = F.upper(key), F.lit(False)
    for n in SECRET_NAMES:
        named = named | (F.endswith(upper, F.lit(n[1:])) if n.startswith("*") else upper == n)
    return last.isin(*SECRET_WORDS) | ((last == "key") & before.isin(*KEY_QUALIFIERS)) | named


def tool_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def shorten_paths(message: Column) -> Column:
    """Absolute paths of more than two segments keep their last two."""
    return F.regexp_replace(message, r"(?:/[A-Za-z0-9._-]+)+/([A-Za-z0-9._-]+/[A-Za-z0-9._-]+)", r"…/$1")


def one_line(text: Column, most: int = 200) -> Column:
    """Printable text on one line: blanks collapse, other controls go, cut to ``most`` characters."""
    plain = F.regexp_replace(F.regexp_replace(text, "[\t\n\r]", " "), "[\\x00-\\x1f\\x7f]", "")
    return F.substring(F.btrim(F.regexp_replace(plain, " +", " ")), 1, most)


def strip_tag(text: Column, tag: str) -> Column:
    """Drop <tag>...</tag>; what follows an unclosed one goes too."""
    return F.regexp_replace(F.regexp_replace(text, rf"(?s)<{tag}>.*?</{tag}>", ""), rf"(?s)<{tag}>.*$", "")


def unwrap_tag(text: Column, tag: str) -> Column:
    return F.regexp_replace(text, rf"</?{tag}>", "")


def remote_host_path(url: Column) -> Column:
    """Struct of host (lower-case) and path (no .git, no slashes around) of a git remote, scp form included."""
    bare = F.regexp_replace(F.regexp_replace(F.btrim(url), "^[a-z+]+://", ""), "^[^@/]*@", "")
    host = F.lower(F.regexp_extract(bare, "^([^/:]+)", 1))
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/:]+(?::[0-9]+(?=/))?[/:](.*)$", 1), "[?#].*$", "")
    return F.struct(host.alias("host"), F.regexp_replace(F.regexp_replace(path, r"^/+|/+$", ""), r"\.git$", "").alias("path"))


def remote_urls(config: Column) -> Column:
    """Values of all ``url`` lines of a git configuration, in order; an ``=`` in a value stays."""
    lines = F.filter(F.split(config, "\n"), lambda x: x.rlike(r"^\s*url\s*="))
    return F.transform(lines, lambda x: F.regexp_extract(x, r"^\s*url\s*=\s*(.*?)\s*$", 1))


def conversation_id(path: Column) -> Column:
    """A transcript's name without directory and suffix; empty if it is no transcript."""
    return F.regexp_extract(path, r"([^/]+)\.jsonl$", 1)


def without_splices(text: Column, splices: list[str]) -> Column:
    """Text without the given literals, as they are and as they stand inside a JSON string."""
    for s in splices:
        for form in dict.fromkeys((s, json.dumps(s, ensure_ascii=False)[1:-1])):
            text = F.replace(text, F.lit(form), F.lit(""))
    return text


def expand_root(root: Column, home: str, env: dict[str, str]) -> Column:
    """Struct of ``path`` and ``unset``: a root with ``$VAR``, ``${VAR}`` and a leading ``~`` replaced, once, and cleaned.

    A variable that is unset or empty leaves the path null and is named in ``unset`` (the last one, as it counts).
    Null, empty and what isn't absolute have a null path.
    """
    name = lambda x: F.regexp_extract(x, r"^\$\{?(\w+)\}?$", 1)
    known = F.from_json(F.lit(json.dumps({k: v for k, v in env.items() if v})), "map<string,string>")
    parts = F.regexp_extract_all(root, F.lit(r"(\$\{\w+\}|\$[A-Za-z_]\w*|\$[0-9]|[^$]+|\$)"), 1)
    unset = F.filter(F.transform(parts, name), lambda n: (n != "") & F.try_element_at(known, n).isNull())
    joined = F.array_join(F.transform(parts, lambda x: F.when(name(x) == "", x).otherwise(F.try_element_at(known, name(x)))), "")
    full = F.when(F.startswith(joined, F.lit("~")), F.concat(F.lit(home), F.substr(joined, F.lit(2)))).otherwise(joined)
    path = F.when((F.size(unset) == 0) & F.startswith(full, F.lit("/")), F.concat(F.lit("/"), F.array_join(rooted(full), "/")))
    return F.struct(path.alias("path"), F.try_element_at(unset, F.lit(-1)).alias("unset"))


def rooted(path: Column) -> Column:
    """Segments of an absolute path after cleaning; '..' at the root goes."""
    return F.filter(clean_path(path), lambda p: p != "..")


def in_tree(directory: Column, patterns: list[str]) -> Column:
    """Is a directory the root of a ``<root>/**`` pattern or below it? Other patterns name no tree."""
    found = F.lit(False)
    for p in patterns:
        if p.endswith("/**"):
            root = p[:-3]
            found = found | (directory == root) | F.startswith(directory, F.lit(root + "/"))
    return found


def part_name(source_id: Column, family: Column) -> Column:
    """A source's name inside its family."""
    prefix = F.concat(family, F.lit("-"))
    return F.when(F.startswith(source_id, prefix), F.substr(source_id, F.length(prefix) + 1)).otherwise(source_id)


def human_bytes(n: Column) -> Column:
    out = F.format_string("%d B", n)
    for power, unit in ((1, "KiB"), (2, "MiB"), (3, "GiB")):
        out = F.when(n >= 1024**power, F.format_string(f"%.1f {unit}", F.bround(n.cast("double") / float(1024**power), 1))).otherwise(out)
    return out


def age_text(seconds: Column) -> Column:
    return (
        F.when(seconds < 60, F.lit("just now")).when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit(" min ago")))
        .when(seconds < 86400, F.concat(F.floor(seconds / 3600).cast("string"), F.lit(" h ago"))).otherwise(F.concat(F.floor(seconds / 86400).cast("string"), F.lit(" d ago")))
    )


def glob_regex(pattern: str) -> str:
    """A regular expression for a glob with ``**`` (any depth), ``*``, ``?`` and {a,b}; a leading slash doesn't count."""
    out, k, depth, glob = [], 0, 0, pattern.lstrip("/")
    while k < len(glob):
        c = glob[k]
        if glob[k : k + 3] == "**/":
            out.append("(?:[^/]+/)*")
            k += 3
            continue
        if glob[k : k + 2] == "**":
            out.append(".*")
            k += 2
            continue
        if c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        else:
            out.append({"*": "[^/]*", "?": "[^/]"}.get(c) or (c if c.isalnum() or c in "_/-" else "\\" + c))
        k += 1
    return "^" + "".join(out) + "$"


def matches_any(path: Column, patterns: list[str]) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | path.rlike(glob_regex(p))
    return found


def ancestors(path: Column) -> Column:
    """All directories of an absolute path, the path itself first."""
    parts = F.array_remove(F.split(path, "/"), "")
    up = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/")))
    return F.when(F.size(parts) == 0, F.array(F.lit("/"))).otherwise(up)


def ordered_union(base: Column, more: Column) -> Column:
    """Texts of a list, then those of another that aren't in it; each once, in the order of the lists."""
    empty = F.array().cast("array<string>")
    return F.array_union(F.array_distinct(F.coalesce(base, empty)), F.coalesce(more, empty))
