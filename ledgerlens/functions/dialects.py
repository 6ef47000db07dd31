"""The few expressions whose spelling differs between Spark SQL and the SQL that results are held against."""

from __future__ import annotations


class Spark:
    name = "spark"
    pattern = r"'[\\p{L}\\p{N}_]+'"

    def tokens(self, table: str, key: str, text: str, where: str = "TRUE") -> str:
        """Rows (key, pos, term): lower-case words by position."""
        return f"SELECT {key}, pos, term FROM {table} LATERAL VIEW posexplode(regexp_extract_all(lower({text}), {self.pattern}, 0)) e AS pos, term WHERE {where}"

    def grams(self, table: str, key: str, text: str, where: str = "TRUE") -> str:
        """Rows (key, term): the two-character strings of the raw text."""
        chars = f"SELECT {key}, regexp_extract_all({text}, '(?s).', 0) AS c FROM {table} WHERE {where}"
        return f"SELECT {key}, term FROM ({chars}) LATERAL VIEW explode(zip_with(c, slice(c, 2, size(c)), (x, y) -> x || y)) e AS term WHERE term IS NOT NULL"

    def normal(self, text: str) -> str:
        return rf"trim(regexp_replace({text}, '\\s+', ' '))"

    def sha(self, text: str) -> str:
        return f"sha2({text}, 256)"

    def dot(self, a: str, b: str) -> str:
        return f"aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (s, v) -> s + v)"

    def array(self, term: str, order: str) -> str:
        return f"array_join(transform(array_sort(collect_list(named_struct('o', {order}, 't', {term}))), x -> x.t), ' ')"

    def seconds(self, ts: str) -> str:
        return f"unix_micros(CAST({ts} AS TIMESTAMP)) / 1000000.0D"

    def digits(self, text: str) -> str:
        return rf"regexp_extract({text}, '([0-9]+)', 1)"

    def octets(self, text: str) -> str:
        return f"CAST(octet_length({text}) AS BIGINT)"

    def headings(self) -> str:
        return r"SELECT page_id, pos, title FROM pages LATERAL VIEW posexplode(regexp_extract_all(html, '<h1>([^<]*)</h1>', 1)) e AS pos, title"

    def series(self, n: str) -> str:
        return f"explode(sequence(0, {n}))"


class Duck(Spark):
    name = "duckdb"
    pattern = r"'[\p{L}\p{N}_]+'"

    def tokens(self, table: str, key: str, text: str, where: str = "TRUE") -> str:
        return f"SELECT {key}, CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS pos, unnest(x) AS term FROM (SELECT {key}, regexp_extract_all(lower({text}), {self.pattern}) AS x FROM {table} WHERE {where})"

    def grams(self, table: str, key: str, text: str, where: str = "TRUE") -> str:
        return f"SELECT {key}, x || y AS term FROM (SELECT {key}, unnest(c[1:len(c) - 1]) AS x, unnest(c[2:]) AS y FROM (SELECT {key}, string_split({text}, '') AS c FROM {table} WHERE length({text}) > 1 AND {where}))"

    def normal(self, text: str) -> str:
        return rf"trim(regexp_replace({text}, '\s+', ' ', 'g'))"

    def sha(self, text: str) -> str:
        return f"sha256({text})"

    def dot(self, a: str, b: str) -> str:
        return f"list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"

    def array(self, term: str, order: str) -> str:
        return f"string_agg({term}, ' ' ORDER BY {order})"

    def seconds(self, ts: str) -> str:
        return f"epoch_us({ts}) / 1000000.0"

    def octets(self, text: str) -> str:
        return f"CAST(strlen({text}) AS BIGINT)"

    def headings(self) -> str:
        return r"SELECT page_id, CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS pos, unnest(x) AS title FROM (SELECT page_id, regexp_extract_all(html, '<h1>([^<]*)</h1>', 1) AS x FROM pages)"

    def series(self, n: str) -> str:
        return f"unnest(range(0, {n} + 1))"
