"""Tiny SQL-expression dialect layer for the corpus builder.

The corpus (domain tables derived from the driver tables) must be
byte-identical in Spark and in the DuckDB oracle. The few functions whose
names differ are rendered here; everything else is shared SQL text.
"""

from __future__ import annotations


class Dialect:
    name = "base"

    def sha(self, x: str) -> str:
        raise NotImplementedError

    def b64_of_hex(self, x: str) -> str:
        raise NotImplementedError

    def re_replace_all(self, x: str, pattern: str, repl: str) -> str:
        raise NotImplementedError

    def s(self, x: str) -> str:
        """cast to string"""
        return f"CAST({x} AS STRING)"

    def lit(self, text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    # token of alphanumerics, 38-43 chars, derived from doc id and a salt
    def token(self, salt: str, key: str) -> str:
        h = self.sha(f"{self.lit(salt)} || {self.s(key)}")
        return self.re_replace_all(self.b64_of_hex(h), "[^A-Za-z0-9]", "")

    def hexu(self, salt: str, key: str) -> str:
        return f"upper({self.sha(f'{self.lit(salt)} || {self.s(key)}')})"

    def mix(self, key: str) -> str:
        """Deterministic scramble of an integer id (LCG step), 0 .. 2^31-1."""
        return f"((CAST({key} AS BIGINT) * 1103515245 + 12345) % 2147483648)"


class SparkDialect(Dialect):
    name = "spark"

    def lit(self, text: str) -> str:
        # Spark's SQL parser substitutes ${name} variables even inside string
        # literals, so '${' is emitted as '$' || '{'.
        body = "'" + text.replace("'", "''") + "'"
        return body.replace("${", "$' || '{")

    def sha(self, x):
        return f"sha2({x}, 256)"

    def b64_of_hex(self, x):
        return f"base64(unhex({x}))"

    def re_replace_all(self, x, pattern, repl):
        return f"regexp_replace({x}, {self.lit(pattern)}, {self.lit(repl)})"


class DuckDialect(Dialect):
    name = "duckdb"

    def sha(self, x):
        return f"sha256({x})"

    def b64_of_hex(self, x):
        return f"to_base64(unhex({x}))"

    def re_replace_all(self, x, pattern, repl):
        return f"regexp_replace({x}, {self.lit(pattern)}, {self.lit(repl)}, 'g')"


SPARK = SparkDialect()
DUCK = DuckDialect()
