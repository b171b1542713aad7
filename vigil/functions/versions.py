"""Version strings as text keys that sort as the versions do.

A number is its count of digits, then the digits, so that any length compares
right. Core parts follow each other after commas, zeros at the end dropped (1.2
is 1.2.0); ``!`` ends them, lower than a further part. A pre-release goes before
its release. For ``PyPI`` the phases are dev, a, b, rc, release, post, after an
epoch; everything else is ordered as semantic versions are: numeric identifiers
by value, before alphanumeric ones, fewer before more. Build metadata takes no
part. A part that is no number counts as 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let

# The forms of a version that the two ecosystems define.
SEMVER_CORE, SEMVER_PRE = r"^[v=\s]*([^-+]*)", r"^[^-+]*-([^+]*)"
PEP440 = (r"^\s*v?(?:([0-9]+)!)?([0-9]+(?:\.[0-9]+)*+)(?:[-_.]?(alpha|beta|preview|pre|rc|a|b|c)[-_.]?([0-9]*))?"
          r"(?:(?:[-_.]?(post|rev|r)[-_.]?([0-9]*))|-([0-9]+))?(?:[-_.]?(dev)[-_.]?([0-9]*))?(?:\+.*)?\s*$")
PHASES = {"dev": "1", "alpha": "2", "a": "2", "beta": "3", "b": "3", "c": "4", "rc": "4", "pre": "4", "preview": "4"}
RELEASE, POST = "5", "6"


def number_key(digits: Column) -> Column:
    plain = F.regexp_replace(digits, "^0+", "")
    return F.concat(F.lpad(F.length(plain).cast("string"), 4, "0"), plain)


def _core_key(core: Column) -> Column:
    parts = F.transform(F.split(core, r"\."), lambda p: F.concat(
        F.lit(","), F.when(p.rlike("^[0-9]+$"), number_key(p)).otherwise(F.lit("0000"))))
    return F.concat(F.regexp_replace(F.array_join(parts, ""), "(?:,0000)+$", ""), F.lit("!"))


def semver_key(version: Column) -> Column:
    def pre_key(pre: Column) -> Column:
        ids = F.transform(F.split(pre, r"\."), lambda p: F.when(p.rlike("^[0-9]+$"), F.concat(F.lit("1"), number_key(p)))
                          .otherwise(F.concat(F.lit("2"), p, F.lit("!"))))
        return F.when(pre == "", F.lit("~")).otherwise(F.concat(F.lit("-"), F.array_join(ids, ""), F.lit("0")))

    return F.concat(_core_key(F.regexp_extract(version, SEMVER_CORE, 1)), let(F.regexp_extract(version, SEMVER_PRE, 1), pre_key))


def pep440_key(version: Column) -> Column:
    def of(v: Column) -> Column:
        g = lambda i: F.regexp_extract(v, PEP440, i)
        numbered = lambda phase, n: F.concat(phase, number_key(n))
        phase = F.element_at(F.create_map(*[F.lit(x) for kv in PHASES.items() for x in kv]), g(3))
        post, dev = (g(5) != "") | (g(7) != ""), g(8) != ""
        post_number = F.concat(g(6), g(7))
        first = (F.when(g(3) != "", numbered(phase, g(4))).when(post, numbered(F.lit(POST), post_number))
                 .when(dev, numbered(F.lit(PHASES["dev"]), g(9))).otherwise(F.lit(RELEASE)))
        second = (F.when((g(3) != "") & post, numbered(F.lit(POST), post_number))
                  .when(((g(3) != "") | post) & dev, numbered(F.lit(PHASES["dev"]), g(9))).otherwise(F.lit(RELEASE)))
        third = F.when((g(3) != "") & post & dev, numbered(F.lit(PHASES["dev"]), g(9))).otherwise(F.lit(RELEASE))
        return F.concat(number_key(g(1)), _core_key(g(2)), first, second, third)

    return let(F.lower(version), of)


def version_key(version: Column, ecosystem: Column) -> Column:
    return F.when((ecosystem == "PyPI") & F.lower(version).rlike(PEP440), pep440_key(version)).when(
        ecosystem == "PyPI", F.concat(F.lit("0000"), semver_key(version))).otherwise(semver_key(version))
