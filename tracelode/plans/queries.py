"""The registered queries of the engine, each over its whole table, and the DuckDB SQL that must give the same rows.

Most types don't occur in the driver's tables, so their queries scan a text derived from a table's key columns by functions that both
engines have. DuckDB's regular expressions have no lookaround: its side takes maximal runs and tests their length.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.functions import text as T
from tracelode.operators import codecs, packed, pages, report
from tracelode.operators.scan import scan
from tracelode.operators.validators import validate
from tracelode.sources import pieces, readers
from tracelode.streaming import lines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _flat(found: DataFrame, key: str, *more: str) -> DataFrame:
    """Findings with scalar columns only."""
    return found.select(F.col(key).cast("bigint").alias(key), *more, "type", F.concat_ws("|", "payload").alias("payload"), F.col("certainty").cast("bigint").alias("certainty"), "confidence")


def _query(name: str, sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


# The SQL side

WORDS, HEXES = "unnest(regexp_extract_all(t, '[A-Za-z0-9_]+'))", "unnest(regexp_extract_all(t, '[0-9A-Fa-f]+'))"
CRYPTS = "unnest(regexp_extract_all(t, '[A-Za-z0-9./]+'))"


def _random(x: str) -> str:
    return f"coalesce(list_aggregate(string_split({x}, ''), 'entropy') > {T.RANDOM}, false)"


def _upper(x: str) -> str:
    return f"regexp_full_match({x}, '[A-Z0-9]*')"


def _hex(x: str, n: int) -> str:
    return f"(length({x}) = {n} AND regexp_full_match({x}, '[0-9A-Fa-f]+'))"


def _rows(source: str, key: str, *parts: str, more: str = "") -> str:
    """parts: selections of (key, type, payload, certainty) from d(key, t)."""
    return f"""WITH d AS ({source}), f AS ({' UNION ALL '.join(parts)})
SELECT key AS {key}{more}, type, payload, CAST(certainty AS BIGINT) AS certainty,
 CASE WHEN certainty >= 80 THEN 'confident' WHEN certainty >= 60 THEN 'likely' ELSE 'possible' END AS confidence FROM f"""


def _digests(types: dict[str, tuple[int, str]]) -> str:
    """type -> (digits, certainty in terms of w), over words that are all hex."""
    return " UNION ALL ".join(f"SELECT key, '{k}' AS type, w AS payload, {c} AS certainty FROM (SELECT key, {WORDS} AS w FROM d) WHERE {_hex('w', n)}" for k, (n, c) in types.items())


def _boosted(low: int, high: int, x: str = "w") -> str:
    return f"CASE WHEN {_random(x)} THEN {high} ELSE {low} END"


MD5_SQL = " UNION ALL ".join(
    f"SELECT key, '{name}' AS type, p AS payload, {_boosted(10, high, 'p')} AS certainty FROM (SELECT key, substr(x, CAST(32 * i + 1 AS BIGINT), 32) AS p FROM (SELECT key, x, unnest(range(length(x) // 32)) AS i FROM (SELECT key, {HEXES} AS x FROM d)))" for name, high in (("md4", 30), ("md5", 80))
)
LM_SQL = " UNION ALL ".join(f"SELECT key, '{k}' AS type, x AS payload, CASE WHEN NOT {_upper('x')} THEN 50 WHEN {_random('x')} THEN 80 ELSE 60 END AS certainty FROM (SELECT key, {HEXES} AS x FROM d) WHERE length(x) = 32" for k in ("lm", "ntlm"))
MSSQL2005_SQL = f"SELECT key, 'mssql2005' AS type, substr(b, 1, 8) || '|' || substr(b, 9, 40) AS payload, CASE WHEN w LIKE '0x%' THEN 95 WHEN {_random('b')} THEN 75 ELSE 55 END AS certainty FROM (SELECT key, w, regexp_replace(w, '^0x0100', '') AS b FROM (SELECT key, {WORDS} AS w FROM d)) WHERE {_hex('b', 48)}"
MSSQL2000_SQL = f"SELECT key, 'mssql2000' AS type, substr(b, 1, 8) || '|' || substr(b, 9, 40) || '|' || substr(b, 49, 40) AS payload, CASE WHEN w LIKE '0x%' THEN 95 ELSE 55 END AS certainty FROM (SELECT key, w, regexp_replace(w, '^0x0100', '') AS b FROM (SELECT key, {WORDS} AS w FROM d)) WHERE regexp_matches(b, '^[0-9A-Fa-f]{{88}}')"
CRYPT31_SQL = " UNION ALL ".join(f"SELECT key, '{k}' AS type, substr(x, length(x) - 30) AS payload, 45 AS certainty FROM (SELECT key, {CRYPTS} AS x FROM d) WHERE length(x) = 31 AND x NOT LIKE '%/%'" for k in ("md5-wordpress", "md5-phpBB3"))

DES_SQL = "SELECT key, 'des-salt-unix' AS type, substr(x, 1, 2) || '|' || substr(x, 3) AS payload, 55 AS certainty FROM (SELECT key, unnest(regexp_extract_all(t, '[$]?[A-Za-z0-9./]+')) AS x FROM d) WHERE length(x) = 13 AND x NOT LIKE '$%'"
CRC_SQL = "SELECT key, 'CRC' AS type, x AS payload, CASE WHEN length(x) IN (1, 2, 3, 4, 6, 8, 10, 16) THEN 15 ELSE 0 END AS certainty FROM (SELECT key, unnest(regexp_extract_all(t, '0x([0-9A-Fa-f]+)', 1)) AS x FROM d) WHERE length(x) <= 16"
BASE64_SQL = "SELECT key, 'base64' AS type, t AS payload, CASE WHEN t LIKE '%=' THEN 80 ELSE 40 END AS certainty FROM d WHERE length(t) % 4 = 0 AND regexp_full_match(t, '[A-Za-z0-9+/]+={0,2}')"
UUID_SQL = "SELECT key, 'uuid' AS type, x AS payload, CASE WHEN substr(x, 15, 1) IN ('1', '2', '3', '5') OR substr(x, 15, 1) = '4' AND substr(x, 20, 1) IN ('8', '9', 'a', 'b', 'A', 'B') THEN 75 ELSE 5 END AS certainty FROM (SELECT key, unnest(regexp_extract_all(t, '[0-9A-Fa-f-]+')) AS x FROM d) WHERE regexp_full_match(x, '[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}')"
JOOMLA_SQL = f"SELECT key, 'md5-joomla1' AS type, x AS payload, 45 AS certainty FROM (SELECT key, {CRYPTS} AS x FROM d) WHERE length(x) = 32 AND regexp_full_match(x, '[a-z0-9./]+')"
DOCUMENTS, CUSTOMER = "SELECT doc_id AS key, text AS t FROM documents", "SELECT c_custkey AS key, {} AS t FROM customer"

# Documents and pages as they are


def _documents(name: str, detectors: Sequence[str], *sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _flat(scan(_table(spark, sf_dir, "documents"), ids=["doc_id"], detectors=detectors), "doc_id")

    QUERIES[name] = run
    ORACLE_SQL[name] = _rows(DOCUMENTS, "doc_id", *sql)


_documents("sha1_documents", ["sha1"], _digests({"sha1": (40, _boosted(15, 65))}))
_documents("md5_md4_documents", ["md5"], MD5_SQL)
_documents("mysql4_documents", ["MySQL4+"], _digests({"MySQL4+": (40, "50")}))
_documents("mysql323_documents", ["MySQL323"], _digests({"MySQL323": (16, "40")}))

_CARD = r"\b[0-9](?:[ -]*[0-9]){12,15}\b"
#: Fixed values, as in the catalogue.
_BRANDS = ("4[0-9]{12}(?:[0-9]{3})?", "5[1-5][0-9]{14}", "3[47][0-9]{13}", "3(?:0[0-5]|[68][0-9])[0-9]{11}", "6(?:011|5[0-9]{2})[0-9]{12}", "(?:2131|1800|35[0-9]{3})[0-9]{11}")
CREDIT_SQL = f"SELECT key, 'credit' AS type, CASE {' '.join(f"WHEN regexp_matches(x, '{b}') THEN regexp_extract(x, '{b}')" for b in _BRANDS)} ELSE x END AS payload, CASE WHEN regexp_matches(x, '{'|'.join(_BRANDS)}') THEN 45 ELSE 15 END AS certainty FROM (SELECT key, unnest(regexp_extract_all(t, '{_CARD}')) AS x FROM d)"
_documents("credit_documents", ["credit"], CREDIT_SQL)

_S = r"[-.\s]?"
_TEN, _AREA, _SEVEN = f"[0-9]{{3}}{_S}[0-9]{{3}}{_S}[0-9]{{4}}", rf"\([0-9]{{3}}\)\s*[0-9]{{3}}{_S}[0-9]{{4}}", f"[0-9]{{3}}{_S}[0-9]{{4}}"
PHONE_SQL = rf"SELECT key, 'phone' AS type, regexp_extract(x, '{_TEN}|{_AREA}|{_SEVEN}') AS payload, CASE WHEN regexp_matches(x, '^(?:\+{_TEN}|{_AREA}|{_SEVEN}[^0-9])') THEN 55 ELSE 40 END AS certainty FROM (SELECT key, unnest(regexp_extract_all(t, '[^0-9]{_TEN}|{_AREA}|{_SEVEN}[^0-9]')) AS x FROM d)"
_documents("phone_documents", ["phone"], PHONE_SQL)

URL_SQL = r"SELECT key, 'URL' AS type, x AS payload, CASE WHEN regexp_matches(x, '://[^/]+/') THEN 90 ELSE 70 END AS certainty FROM (SELECT key, unnest(regexp_extract_all(t, '[A-Za-z0-9]+://[A-Za-z0-9./]+\b')) AS x FROM d) WHERE regexp_matches(x, '://[^/]')"
COOKIE_SQL = rf"SELECT key, 'web-cookie' AS type, n || '|' || v AS payload, CASE WHEN regexp_matches(lower(n), '_utm|apsession|sessionid|web_session') AND {_random('v')} THEN 85 ELSE 45 END AS certainty FROM (SELECT key, regexp_extract(x, '^;?([^=]+)=', 1) AS n, substr(x, strpos(x, '=') + 1) AS v FROM (SELECT key, unnest(regexp_extract_all(t, ';?[A-Za-z0-9_:|\-$&%#@]+=[^;\s]+')) AS x FROM d))"


@_query("url_pages", _rows("SELECT page_id AS key, url AS t FROM pages", "page_id", URL_SQL))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(scan(_table(spark, sf_dir, "pages"), "url", ["page_id"], detectors=["URL"]), "page_id")


@_query("cookie_pages", _rows("SELECT page_id AS key, html AS t FROM pages", "page_id", COOKIE_SQL))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(scan(_table(spark, sf_dir, "pages"), "html", ["page_id"], detectors=["web-cookie"]), "page_id")


@_query("entropy_tokens", f"SELECT c_custkey, round(list_aggregate(string_split(c_name || c_mktsegment, ''), 'entropy'), 6) AS entropy, {_random('c_name || c_mktsegment')} AS random_looking FROM customer")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.concat("c_name", "c_mktsegment")
    return _table(spark, sf_dir, "customer").select("c_custkey", F.round(T.entropy(s), 6).alias("entropy"), T.random_looking(s).alias("random_looking"))


# Texts derived from customers; {md5}, {sha1}, {sha256} of the name


def _expression(spark_side: bool, template: str) -> str:
    return template.format(md5="md5(c_name)", sha1="sha1(c_name)", sha256="sha2(c_name, 256)" if spark_side else "sha256(c_name)")


def _derived_table(spark: SparkSession, sf_dir: str, template: str) -> DataFrame:
    return readers.spread(_table(spark, sf_dir, "customer")).select("c_custkey", F.expr(_expression(True, template)).alias("text"))


def _derived(name: str, template: str, *sql: str, detectors: Sequence[str] | None = None, **options) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _flat(scan(_derived_table(spark, sf_dir, template), ids=["c_custkey"], detectors=detectors, **options), "c_custkey")

    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = _rows(CUSTOMER.format(_expression(False, template)), "c_custkey", *sql)


_LENGTHS = "{sha1} || ' ' || {sha256} || ' ' || substr({sha256}, 1, 56) || ' ' || {md5} || {sha256} || ' ' || {sha256} || {sha256} || ' ' || {sha1} || {sha1} || ' ' || {md5} || substr({md5}, 1, 16) || ' ' || {sha1} || {sha1} || substr({md5}, 1, 8) || ' ' || substr({md5}, 1, 16) || ' ' || {md5}"
_LENGTH_SQL = [
    _digests({"sha1": (40, _boosted(15, 65)), "sha224": (56, _boosted(15, 65)), "sha256": (64, _boosted(15, 65)), "sha384": (96, _boosted(15, 65)), "sha512": (128, _boosted(15, 65)), "whirlpool": (128, _boosted(5, 20)), "RipeMD320": (80, "10"), "MySQL4+": (40, "50"), "MySQL323": (16, "40")}),
    MD5_SQL, LM_SQL, MSSQL2005_SQL, MSSQL2000_SQL,
]
_derived("hex_length_dispatch", _LENGTHS, *_LENGTH_SQL, detectors=["sha1", "sha224", "sha256", "sha384", "sha512", "RipeMD320", "MySQL4+", "MySQL323", "md5", "lm", "mssql2005", "mssql2000"])
_derived("lm_ntlm_derived", "upper({md5}) || ' ' || {md5} || ' ' || {md5} || '0'", LM_SQL, detectors=["lm"])

_SAM = "CASE c_custkey % 4 WHEN 0 THEN 'user' || c_custkey || ':' || c_custkey || ':' || upper({md5}) || ':' || upper(substr({sha1}, 1, 32)) || ':::' WHEN 1 THEN 'user:' || c_custkey || ':' || {md5} || ':*' WHEN 2 THEN 'user:' || c_custkey || ':*:' || upper({md5}) ELSE {md5} || ':' || substr({sha1}, 1, 32) END"
_derived(
    "sam_derived", _SAM,
    f"SELECT key, 'SAM(lm:ntlm)' AS type, a || '|' || b AS payload, CASE WHEN p AND {_random('a')} AND {_random('b')} THEN CASE WHEN {_upper('a || b')} THEN 90 ELSE 80 END ELSE 50 END AS certainty FROM (SELECT key, regexp_matches(t, '^[A-Za-z0-9_]+:[0-9]+:') AS p, regexp_extract(t, '([0-9A-Fa-f]{{32}}):[0-9A-Fa-f]{{32}}', 1) AS a, regexp_extract(t, '[0-9A-Fa-f]{{32}}:([0-9A-Fa-f]{{32}})', 1) AS b FROM d WHERE regexp_matches(t, '[0-9A-Fa-f]{{32}}:[0-9A-Fa-f]{{32}}'))",
    f"SELECT key, 'SAM(lm:*)' AS type, a AS payload, CASE WHEN {_upper('a')} AND {_random('a')} THEN 70 WHEN {_random('a')} THEN 85 ELSE 40 END AS certainty FROM (SELECT key, regexp_extract(t, '([0-9A-Fa-f]{{32}}):[*]', 1) AS a FROM d) WHERE a <> ''",
    f"SELECT key, 'SAM(*:ntlm)' AS type, a AS payload, CASE WHEN {_upper('a')} AND {_random('a')} THEN 85 ELSE 40 END AS certainty FROM (SELECT key, regexp_extract(t, ':[*]:([0-9A-Fa-f]{{32}})', 1) AS a FROM d) WHERE a <> ''",
    detectors=["SAM(lm:ntlm)", "SAM(lm:*)", "SAM(*:ntlm)"],
)
_derived("mssql_derived", "'0x0100' || {md5} || substr({sha1}, 1, 16) || ' ' || substr({sha256}, 1, 48) || ' 0x0100' || {sha256} || substr({sha1}, 1, 24) || ' ' || {sha256} || substr({sha1}, 1, 24) || 'f'", MSSQL2005_SQL, MSSQL2000_SQL, detectors=["mssql2005", "mssql2000"])
_derived("crc_derived", "'0x' || substr({sha1}, 1, CAST(c_custkey % 18 + 1 AS INT)) || ' x0x' || substr({md5}, 1, 4)", CRC_SQL, detectors=["CRC"])
_derived("uuid_derived", "'id ' || substr({md5}, 1, 8) || '-' || substr({md5}, 9, 4) || '-' || substr({md5}, 13, 4) || '-' || substr({md5}, 17, 4) || '-' || substr({md5}, 21, 12) || '.'", "SELECT key, 'uuid' AS type, x AS payload, CASE WHEN substr(x, 15, 1) IN ('1', '2', '3', '5') OR substr(x, 15, 1) = '4' AND substr(x, 20, 1) IN ('8', '9', 'a', 'b') THEN 75 ELSE 5 END AS certainty FROM (SELECT key, substr(t, 4, 36) AS x FROM d)", detectors=["uuid"])
_derived("base64_derived", "CASE c_custkey % 3 WHEN 0 THEN substr({sha1}, 1, 39) || '=' WHEN 1 THEN substr({md5}, 1, CAST(c_custkey % 7 + 1 AS INT)) ELSE {sha1} || '==' END", BASE64_SQL, detectors=["base64"])
_DES = "substr({md5}, 1, CAST(11 + c_custkey % 4 AS INT)) || ' $' || substr({sha1}, 1, 13) || ' ' || substr({sha1}, 1, 13)"
_derived("des_derived", _DES, DES_SQL, detectors=["des-salt-unix"])
_derived("des_only_unix_derived", _DES, DES_SQL.replace("55 AS", "80 AS"), detectors=["des-salt-unix"], filters=["unix"])
_derived(
    "mysql4_star_derived", "'x*' || upper({sha1}) || ' *' || upper({sha1}) || ' y*' || {sha1} || ' ' || {sha1}",
    f"SELECT key, 'MySQL4+' AS type, h AS payload, CASE WHEN i = 1 AND {_random('h')} THEN 80 ELSE 50 END AS certainty FROM (SELECT key, unnest(regexp_extract_all(t, '[0-9A-Fa-f]{{40}}')) AS h, unnest(range(1, 5)) AS i FROM d)",
    detectors=["MySQL4+"],
)
_derived(
    "strict_derived", "CASE c_custkey % 4 WHEN 0 THEN 'sha1$sa/lt$' || {sha256} WHEN 1 THEN 'sha1$salt$' || {sha256} WHEN 2 THEN ':' || upper({md5}) ELSE 'sha384$sa.lt$' || {sha256} || {md5} END",
    "SELECT key, CASE WHEN t LIKE 'sha384%' THEN 'sha384-salt-django' ELSE 'sha256-salt-django' END AS type, string_split(t, '$')[2] || '|' || string_split(t, '$')[3] AS payload, 65 AS certainty FROM d WHERE t LIKE 'sha%' AND NOT contains(string_split(t, '$')[2], '/')",
    detectors=["sha256-salt-django", "sha384-salt-django", "SAM(*:ntlm)"], strict=True,
)
_derived(
    "django_derived", "CASE c_custkey % 4 WHEN 0 THEN 'sha1$salt$' || {sha256} WHEN 1 THEN 'sha256$$' || {sha256} WHEN 2 THEN 'sha384$s.alt$' || {sha256} || {md5} ELSE 'sha384$$' || {sha256} || {md5} END",
    "SELECT key, CASE key % 4 WHEN 0 THEN 'sha256-salt-django' WHEN 1 THEN 'sha256-django' WHEN 2 THEN 'sha384-salt-django' ELSE 'sha384-django' END AS type, CASE WHEN key % 2 = 0 THEN string_split(t, '$')[2] || '|' || string_split(t, '$')[3] ELSE string_split(t, '$')[3] END AS payload, 65 AS certainty FROM d",
    detectors=["sha256-salt-django", "sha256-django", "sha384-salt-django", "sha384-django"],
)
_derived(
    "unix_crypt_derived", "'a:$5$saltsalt$' || substr({sha256}, 1, 43) || ' b:$6$' || substr({md5}, 1, 16) || '$' || {sha256} || substr({sha1}, 1, 22) || ' c:$1$' || substr({md5}, 1, 8) || '$' || substr({sha1}, 1, 22) || ' d:$apr1$' || substr({md5}, 9, 8) || '$' || substr({sha1}, 1, 22) || ' e:$2a$10$' || substr({sha256}, 1, 53)",
    *[rf"SELECT key, '{k}' AS type, a || '|' || b AS payload, {c} AS certainty FROM (SELECT key, regexp_extract(t, '{p}', 1) AS a, regexp_extract(t, '{p}', 2) AS b FROM d)" for k, p, c in (
        ("sha256-salt-unix", r"\$5\$([^$]*)\$([^ ]*)", "55"), ("sha512-salt-unix", r"\$6\$([^$]*)\$([^ ]*)", "55"), ("apr1-salt-unix", r"\$apr1\$([^$]*)\$([^ ]*)", "45"), ("md5-salt-unix", r"\$1\$([^$]*)\$([^ ]*)", _boosted(45, 80, "b")), ("md5-salt-unix", r"\$apr1\$([^$]*)\$([^ ]*)", _boosted(45, 80, "b")), ("blowfish-salt-unix", r"\$2a\$([^$]*)\$([^ ]*)", _boosted(55, 85, "b")))],
    detectors=["sha256-salt-unix", "sha512-salt-unix", "apr1-salt-unix", "md5-salt-unix", "blowfish-salt-unix"],
)
_derived(
    "joomla_wordpress_phpbb_derived", "'$P$' || substr({sha1}, 1, 31) || ' $H$' || substr({md5}, 1, CAST(30 + c_custkey % 3 AS INT)) || ' ' || {md5} || ':' || substr({sha1}, 1, 16) || ' ' || upper({md5})",
    CRYPT31_SQL, JOOMLA_SQL,
    detectors=["md5-wordpress", "md5-phpBB3", "md5-joomla1"],
)
_derived(
    "joomla_extended", "{md5} || ':' || substr({sha1}, 1, 32) || ' ' || {md5} || ':' || substr({sha1}, 1, 16) || ' ' || substr({sha1}, 3, 32)",
    "SELECT key, 'md5-salt-joomla2' AS type, substr(t, 1, 32) || '|' || substr(t, 34, 32) AS payload, 85 AS certainty FROM d", "SELECT key, 'md5-joomla2' AS type, substr(t, 67, 32) AS payload, 50 AS certainty FROM d", "SELECT key, 'md5-joomla2' AS type, substr(t, 117, 32) AS payload, 50 AS certainty FROM d",
    "SELECT key, 'md5-salt-joomla1' AS type, substr(t, 67, 32) || '|' || substr(t, 100, 16) AS payload, 85 AS certainty FROM d", *[f"SELECT key, 'md5-joomla1' AS type, substr(t, {k}, 32) AS payload, 45 AS certainty FROM d" for k in (1, 34, 117)],
    detectors=["md5-joomla1", "md5-joomla2"], extended=True,
)
SECRET_SQL = f"""SELECT key, 'secret' AS type, x AS payload, 45 - CASE WHEN regexp_matches(trim(trim(trim(x, '"'), '''')), '^(?i:/|-|keystore_|\\{{\\{{|\\$|secret|configmap|\\[|true|false)') THEN 25 ELSE 0 END + CASE WHEN {_random('x')} THEN 40 ELSE 0 END AS certainty FROM (SELECT key, unnest(regexp_extract_all(l, '[^=|:]+')) AS x, k FROM (SELECT key, l, unnest(['pass', 'key', 'security']) AS k FROM (SELECT key, unnest(string_split(replace(t, chr(92) || 'n', chr(10)), chr(10))) AS l FROM d)) WHERE contains(lower(l), k))"""
_derived("secret_derived", "'user = ' || c_name || chr(10) || 'Password = ' || CASE c_custkey % 3 WHEN 0 THEN {md5} WHEN 1 THEN 'true' ELSE '\"$VALUE' END || chr(10) || 'api_key:pass|' || {sha1}", SECRET_SQL, detectors=["secret"])
_derived("jwt_derived", "'x eyJhbGciOiJub25lIn01.' || substr({sha256}, 1, CAST(8 + c_custkey % 5 AS INT)) || '.' || CASE WHEN c_custkey % 2 = 0 THEN {md5} ELSE '' END", "SELECT key, 'jwt' AS type, substr(t, 3) AS payload, 85 AS certainty FROM d WHERE length(string_split(t, '.')[2]) % 4 = 0", detectors=["jwt"])
_derived(
    "jwt_rejected_derived", "'a ' || CASE c_custkey % 4 WHEN 0 THEN 'eyJhbGciOiJub25lIn01' WHEN 1 THEN 'abJhbGciOiJub25lIn01' WHEN 2 THEN 'eyJAAAAA' ELSE 'eyJhbGciOiJub25lIn0' END || '.' || substr({sha256}, 1, 16) || '.x'",
    "SELECT key, 'jwt' AS type, t AS payload, 85 AS certainty FROM (SELECT key, substr(t, 3) AS t, string_split(substr(t, 3), '.')[1] AS h FROM d) WHERE h LIKE 'eyJ%' AND CASE WHEN length(h) % 4 = 0 THEN regexp_full_match(decode(from_base64(h)), '[ -~]*') ELSE false END",
    detectors=["jwt"],
)

# Filters, validators, reports

_MIXED = "upper({md5}) || ' ' || {sha1} || ' http://' || c_mktsegment || '.com/' || c_custkey || ' 0x' || substr({md5}, 1, 8) || ' name=' || substr({sha1}, 1, 12)"
_MIXED_RULES = [_digests({"sha1": (40, _boosted(15, 65)), "MySQL4+": (40, "50")}), MD5_SQL, LM_SQL, URL_SQL, COOKIE_SQL, "SELECT key, 'CRC' AS type, substr({}, 1, 8) AS payload, 15 AS certainty FROM d".format("regexp_extract(t, '0x([0-9a-f]+)', 1)")]
_MIXED_NAMES = ["sha1", "MySQL4+", "md5", "lm", "URL", "web-cookie", "CRC"]
_MIXED_SQL = _rows(CUSTOMER.format(_expression(False, _MIXED)), "c_custkey", *_MIXED_RULES)


def _mixed(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return scan(_derived_table(spark, sf_dir, _MIXED), ids=["c_custkey"], detectors=_MIXED_NAMES, **options)


@_query("mixed_derived", _MIXED_SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_mixed(spark, sf_dir), "c_custkey")


@_query("min_certainty_filter", f"SELECT * FROM ({_MIXED_SQL}) WHERE certainty >= 65")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_mixed(spark, sf_dir, min_certainty=65), "c_custkey")


@_query("category_filter_web", f"SELECT * FROM ({_MIXED_SQL}) WHERE type IN ('md4', 'md5', 'URL', 'web-cookie')")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_mixed(spark, sf_dir, filters=["web"]), "c_custkey")


_CLEAN = "replace(replace(payload, '|', ''), '-', '')"
for _name, _validators, _combine, _test in (
    ("validators_all_upper", ["all:UPPER"], "or", f"regexp_full_match({_CLEAN}, '[A-Z]*')"),
    ("validators_has_symbol", ["has:SYMBOL"], "or", f"regexp_matches({_CLEAN}, '[^A-Za-z0-9]')"),
    ("validators_search", ["search:^[0-9a-f]+$"], "or", f"regexp_matches({_CLEAN}, '^[0-9a-f]+$')"),
    ("validators_and", ["has:LOWER", "all:ALPHANUMERIC"], "and", f"regexp_matches({_CLEAN}, '[a-z]') AND regexp_full_match({_CLEAN}, '[A-Za-z0-9]*')"),
    ("validators_or", ["all:NUMERIC", "has:SYMBOL", "all:LOWER"], "or", f"regexp_full_match({_CLEAN}, '[0-9]*') OR regexp_matches({_CLEAN}, '[^A-Za-z0-9]') OR regexp_full_match({_CLEAN}, '[a-z]*')"),
):
    QUERIES[_name] = lambda spark, sf_dir, v=_validators, c=_combine: _flat(validate(_mixed(spark, sf_dir), v, c), "c_custkey")
    ORACLE_SQL[_name] = f"SELECT * FROM ({_MIXED_SQL}) WHERE {_test}"

_ROLLUP_SQL = _rows(DOCUMENTS, "doc_id", _digests({"sha1": (40, _boosted(15, 65)), "MySQL4+": (40, "50"), "MySQL323": (16, "40")}), MD5_SQL, CREDIT_SQL, PHONE_SQL)


@_query("confidence_rollup", f"SELECT type, confidence, count(*) AS n_findings, CAST(max(certainty) AS BIGINT) AS max_certainty, CAST(min(certainty) AS BIGINT) AS min_certainty FROM ({_ROLLUP_SQL}) GROUP BY type, confidence")
def rollup_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(_table(spark, sf_dir, "documents"), ids=["doc_id"], detectors=["sha1", "MySQL4+", "MySQL323", "md5", "credit", "phone"])
    return report.rollup(found).withColumns({c: F.col(c).cast("bigint") for c in ("max_certainty", "min_certainty")})


_OFFSETS_SQL = r"""WITH d AS (SELECT doc_id, string_split_regex(text, '[0-9A-Fa-f]{32}') AS g, regexp_extract_all(text, '[0-9A-Fa-f]{32}') AS m FROM documents),
 f AS (SELECT doc_id, m, g, unnest(range(len(m))) AS i FROM d WHERE len(m) > 0)
SELECT doc_id, m[i + 1] AS payload, CAST(i AS BIGINT) AS match_seq, CAST(list_sum(list_transform(g[1:i + 1], lambda x: length(x))) + 32 * i AS BIGINT) AS location, CAST(32 AS BIGINT) AS size FROM f"""


@_query("findings_offsets", _OFFSETS_SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(_table(spark, sf_dir, "documents"), ids=["doc_id"], detectors=["md5"]).filter("type = 'md5'")
    return found.select("doc_id", F.element_at("payload", 1).alias("payload"), F.col("match_seq").cast("bigint").alias("match_seq"), "location", F.col("size").cast("bigint").alias("size"))


@_query("findings_display", f"SELECT c_custkey, 'SHA-1 digest: ' || payload || ' [sha1 at 33, ' || confidence || ': ' || certainty || ']' AS line FROM ({_MIXED_SQL}) WHERE type = 'sha1'")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.displayed(scan(_derived_table(spark, sf_dir, _MIXED), ids=["c_custkey"], detectors=["sha1"]), details=True).select("c_custkey", "line")


# Windows, pages, codecs, packed records, streams

_WINDOWS_SQL = r"""WITH d AS (SELECT doc_id, string_split_regex(text, '[A-Za-z0-9_]+') AS g, regexp_extract_all(text, '[A-Za-z0-9_]+') AS m FROM documents WHERE regexp_matches(text, '[0-9A-Fa-f]{40}')),
 f AS (SELECT doc_id, m, g, unnest(range(len(m))) AS i FROM d)
SELECT doc_id, m[i + 1] AS payload, CAST(list_sum(list_transform(g[1:i + 1], lambda x: octet_length(encode(x)))) + coalesce(list_sum(list_transform(m[1:i], lambda x: length(x))), 0) AS BIGINT) AS location FROM f
WHERE length(m[i + 1]) = 40 AND regexp_full_match(m[i + 1], '[0-9A-Fa-f]+')"""


@_query("window_overlap_dedupe", _WINDOWS_SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as files, in windows of 1,000 bytes with an overlap of 100; each digest at its byte, once."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source"), F.col("text").cast("binary").alias("content"))
    found = scan(readers.windows(docs, 1000, 100), ids=["source"], base_offset="base_offset", keep=("keep_from", "keep_to"), detectors=["sha1"])
    return found.select(F.col("source").cast("bigint").alias("doc_id"), F.element_at("payload", 1).alias("payload"), "location")


_EDGES = "repeat('. ', CAST(c_custkey % 600 AS INT)) || {sha256} || {sha256} || repeat('-', CAST(c_custkey % 7 + 1 AS INT)) || {sha1} || ' ' || {sha256} || substr({md5}, 1, CAST(c_custkey % 33 AS INT)) || repeat(' _', 150) || ' ' || {sha1}"
_EDGES_SQL = f"""WITH t AS (SELECT c_custkey, {_expression(False, _EDGES)} AS t FROM customer),
 d AS (SELECT c_custkey, string_split_regex(t, '[A-Za-z0-9_]+') AS g, regexp_extract_all(t, '[A-Za-z0-9_]+') AS m FROM t),
 f AS (SELECT c_custkey, m[i + 1] AS payload, CAST(list_sum(list_transform(g[1:i + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i], lambda x: length(x))), 0) AS BIGINT) AS location FROM (SELECT c_custkey, m, g, unnest(range(len(m))) AS i FROM d))
SELECT c_custkey, type, payload, location FROM f JOIN (VALUES (40, 'sha1'), (64, 'sha256'), (96, 'sha384'), (80, 'RipeMD320'), (128, 'sha512'), (128, 'whirlpool')) k(n, type) ON length(payload) = n WHERE regexp_full_match(payload, '[0-9A-Fa-f]+')"""


@_query("window_edges_hex", _EDGES_SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests at every place of a window and across its edges; the SQL takes the texts whole."""
    content = _derived_table(spark, sf_dir, _EDGES).select(F.col("c_custkey").cast("string").alias("source"), F.col("text").cast("binary").alias("content"))
    found = scan(readers.windows(content, 500, 300), ids=["source"], base_offset="base_offset", keep=("keep_from", "keep_to"), detectors=["sha1", "sha256", "sha384", "RipeMD320", "sha512"])
    return found.select(F.col("source").cast("bigint").alias("c_custkey"), "type", F.element_at("payload", 1).alias("payload"), "location")


@_query("page_verdict", f"""WITH d AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 2 = 0 THEN upper(md5(c_name)) ELSE 'x ' || md5(c_name) || ' ' || sha1(c_name) END AS t FROM customer)
SELECT key AS c_custkey, CASE WHEN key % 2 = 0 THEN 'lm,ntlm' ELSE '' END AS confident, CASE WHEN key % 2 = 0 THEN 'md5' ELSE 'md5,lm,ntlm' END AS likely, 'md4' AS possible FROM d""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("CASE WHEN c_custkey % 2 = 0 THEN upper(md5(c_name)) ELSE 'x ' || md5(c_name) || ' ' || sha1(c_name) END")
    found = pages.verdicts(readers.spread(_table(spark, sf_dir, "customer")).select("c_custkey", text.alias("text")), ids=["c_custkey"], filters="win")
    return found.select("c_custkey", *[F.concat_ws(",", level).alias(level) for level in pages.LEVELS])


_SEEN = "CASE c_custkey % 6 WHEN 0 THEN 'x*' || upper({sha1}) WHEN 1 THEN 'u:$1$abcdefgh$' || substr({sha1}, 1, 22) WHEN 2 THEN 'id ' || substr({md5}, 1, 8) || '-' || substr({md5}, 9, 4) || '-' || substr({md5}, 13, 4) || '-' || substr({md5}, 17, 4) || '-' || substr({md5}, 21, 12) WHEN 3 THEN 'sha1$salt$' || {sha256} WHEN 4 THEN '0x' || substr({sha1}, 1, 8) ELSE '$P$' || substr({sha1}, 1, 31) END"


@_query("page_verdict_all", """SELECT c_custkey, CASE c_custkey % 6 WHEN 1 THEN 'md5-salt-unix' WHEN 2 THEN 'uuid' WHEN 3 THEN 'sha256-salt-django' WHEN 5 THEN 'md5-wordpress' ELSE '' END AS confident,
 CASE c_custkey % 6 WHEN 0 THEN 'MySQL4+,sha1' WHEN 3 THEN 'sha256' ELSE '' END AS likely, CASE c_custkey % 6 WHEN 4 THEN 'CRC' WHEN 5 THEN 'md5-phpBB3' ELSE '' END AS possible FROM customer""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.verdicts(_derived_table(spark, sf_dir, _SEEN), ids=["c_custkey"], filters="db,unix,web,win,other", uuids=True)
    return found.select("c_custkey", *[F.concat_ws(",", level).alias(level) for level in pages.LEVELS])


@_query("page_processes_shown", """SELECT c_custkey, CAST(8192 AS BIGINT) AS vpage, 'Found md5 (likely)' || chr(9) || 'MD5 digest: ' || h || chr(9) || 'LM hash: ' || h || chr(9) || 'NTLM hash: ' || h || chr(10) || 'Found md4 (possible)' || chr(9) || 'MD4 digest: ' || h AS line
FROM (SELECT c_custkey, upper(md5(c_name)) AS h FROM customer WHERE c_custkey % 5 IN (1, 3))""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests across the edge of two pages, which the first one reads over, in the pages of some processes."""
    memory = readers.spread(_table(spark, sf_dir, "customer")).select("c_custkey", (F.col("c_custkey") % 5).alias("pid"), F.concat(F.lit("proc"), F.col("c_custkey") % 5).alias("pname"), F.lit(8192).cast("bigint").alias("vpage"), F.concat(F.repeat(F.lit(". "), F.lit(2040)), F.upper(F.md5("c_name")), F.lit(" .")).cast("binary").alias("content"))
    found = pages.verdicts(pages.of_processes(readers.pages(memory), name="proc1", pid=3), ids=["c_custkey", "vpage"], filters="win")
    return pages.shown(found).select("c_custkey", "vpage", "line")


@_query("generator_decode_native", f"SELECT c_custkey, codec, sha1(c_name) AS payload FROM customer, (SELECT unnest(['base64', 'hex', 'rot13']) AS codec) WHERE codec <> 'rot13' OR translate(sha1(c_name), '{codecs.LETTERS}', '{codecs.ROTATED}') = sha1(c_name)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests wrapped in base64 and hex, found in what the codecs make of them."""
    names = readers.spread(_table(spark, sf_dir, "customer")).withColumn("h", F.concat(F.sha1("c_name"), F.lit(".")))
    wrapped = names.select("c_custkey", F.explode(F.array(F.struct(F.lit("base64").alias("by"), F.base64(F.col("h").cast("binary")).alias("text")), F.struct(F.lit("hex").alias("by"), F.lower(F.hex("h")).alias("text")))).alias("x")).select("c_custkey", "x.*")
    found = codecs.scan_generated(wrapped, ids=["c_custkey", "by"], mode="decode", exotic=False, detectors=["sha1"])
    return found.filter("codec = by").select("c_custkey", "codec", F.element_at("payload", 1).alias("payload"))


@_query("generator_python_codecs")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = codecs.scan_generated(readers.spread(_table(spark, sf_dir, "customer")).select("c_custkey", F.sha1("c_name").alias("text")), ids=["c_custkey"], detectors=["sha1"])
    return _flat(found, "c_custkey", "codec", "direction")


@_query("struct_preprocess", "SELECT s_suppkey, s_suppkey || '' || CAST(s_suppkey * 256 AS VARCHAR) AS text FROM supplier")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two big-endian 64-bit numbers and a rest of three bytes, read as records of one number."""
    packed_ = F.concat(F.unhex(F.lpad(F.hex(F.col("s_suppkey")), 16, "0")), F.unhex(F.lpad(F.hex(F.col("s_suppkey") * 256), 16, "0")), F.unhex(F.lit("abcdef")))
    return packed.preprocess(_table(spark, sf_dir, "supplier").select("s_suppkey", packed_.alias("content")), ">q").select("s_suppkey", "text")


#: Which detectors a category has, and the largest certainty of each.
_IN_CATEGORY = {
    "web": "jwt web-cookie md5 URL phone sha256-salt-django sha256-django sha384-salt-django sha384-django apr1-salt-unix md5-wordpress md5-phpBB3 md5-joomla2 md5-joomla1",
    "unix": "md5 des-salt-unix sha256-salt-unix sha512-salt-unix md5-salt-unix blowfish-salt-unix",
    "win": "lm SAM(*:ntlm) SAM(lm:*) SAM(lm:ntlm)",
    "db": "mssql2005 mssql2000 MySQL4+ MySQL323",
    "personal": "URL phone credit",
    "other": "md5 URL phone base64 RipeMD320 sha1 sha224 sha256 sha384 sha512 CRC uuid",
    "secrets": "jwt secret mssql2005 mssql2000 lm MySQL4+ MySQL323 SAM(lm:*) SAM(lm:ntlm)",
    "crypto": "jwt secret web-cookie md5 mssql2005 mssql2000 lm MySQL4+ MySQL323 SAM(*:ntlm) SAM(lm:*) SAM(lm:ntlm) RipeMD320 sha1 sha224 sha256 sha384 sha512 des-salt-unix sha256-salt-django sha256-django sha384-salt-django sha384-django sha256-salt-unix sha512-salt-unix apr1-salt-unix md5-salt-unix md5-wordpress md5-phpBB3 md5-joomla2 md5-joomla1 blowfish-salt-unix",
}
_MOST = "jwt 85, secret 85, web-cookie 85, md5 80, URL 90, phone 55, credit 45, mssql2005 95, mssql2000 95, lm 80, MySQL4+ 80, MySQL323 40, base64 80, SAM(*:ntlm) 85, SAM(lm:*) 85, SAM(lm:ntlm) 90, RipeMD320 10, sha1 65, sha224 65, sha256 65, sha384 65, sha512 65, CRC 15, des-salt-unix 80, sha256-salt-django 65, sha256-django 65, sha384-salt-django 65, sha384-django 65, sha256-salt-unix 55, sha512-salt-unix 55, apr1-salt-unix 45, md5-salt-unix 80, md5-wordpress 45, md5-phpBB3 45, md5-joomla2 85, md5-joomla1 85, blowfish-salt-unix 85, uuid 75"
_CATALOGUE_SQL = f"""WITH m AS (SELECT unnest(string_split('{_MOST}', ', ')) AS x),
 c AS ({' UNION ALL '.join(f"SELECT '{k}' AS category, unnest(string_split('{v}', ' ')) AS name" for k, v in _IN_CATEGORY.items())})
SELECT split_part(x, ' ', 1) AS name, category, CAST(split_part(x, ' ', 2) AS BIGINT) AS max_certainty FROM m JOIN c ON c.name = split_part(x, ' ', 1)"""


_USED_SQL = " UNION ALL ".join(f"SELECT '{n}' AS name, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS w, {k} AS k FROM documents" for n, k in (("sha1", 40), ("MySQL4+", 40), ("MySQL323", 16)))


@_query("detector_catalogue", f"SELECT name, category, max_certainty, coalesce(n, 0) AS n_findings FROM ({_CATALOGUE_SQL}) LEFT JOIN (SELECT name, count(*) AS n FROM ({_USED_SQL}) WHERE length(w) = k AND regexp_full_match(w, '[0-9A-Fa-f]+') GROUP BY name) USING (name)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detectors with their categories, and how many findings some of them have in the documents."""
    found = scan(_table(spark, sf_dir, "documents"), detectors=["sha1", "MySQL4+", "MySQL323"]).groupBy("detector_seq").agg(F.count("*").alias("n"))
    every = report.catalogue(spark).join(found, "detector_seq", "left")
    return every.select("name", F.explode("categories").alias("category"), F.col("max_certainty").cast("bigint").alias("max_certainty"), F.coalesce("n", F.lit(0)).alias("n_findings"))


@_query("sql_view", f"SELECT type, count(*) AS n, max(certainty) AS most FROM ({_MIXED_SQL}) WHERE confidence <> 'possible' GROUP BY type")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings under a name, asked by SQL."""
    report.as_view(_mixed(spark, sf_dir), "mixed_findings")
    return spark.sql("SELECT type, count(*) AS n, CAST(max(certainty) AS BIGINT) AS most FROM mixed_findings WHERE confidence <> 'possible' GROUP BY type")


_AGAIN = "repeat({sha1} || ' ', CAST(c_custkey % 40 + 1 AS INT))"


@_query("overlaps_removed", "SELECT c_custkey, sha1(c_name) AS payload, CAST(41 * i AS BIGINT) AS location FROM (SELECT c_custkey, c_name, unnest(range(c_custkey % 40 + 1)) AS i FROM customer)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What overlapping windows of a fixed size find twice, once."""
    content = _derived_table(spark, sf_dir, _AGAIN).select(F.col("c_custkey").cast("string").alias("source"), F.col("text").cast("binary").alias("content"))
    found = report.without_overlaps(scan(readers.windows(content, 500, 300), ids=["source"], base_offset="base_offset", detectors=["sha1"]))
    return found.select(F.col("source").cast("bigint").alias("c_custkey"), F.element_at("payload", 1).alias("payload"), "location")


#: All default detectors that DuckDB's regular expressions can express (anchored accounts and salted hashes are in queries of their own).
_DEFAULT_SQL = [*_LENGTH_SQL, URL_SQL, COOKIE_SQL, PHONE_SQL, CREDIT_SQL, SECRET_SQL, DES_SQL, CRC_SQL, BASE64_SQL, UUID_SQL, CRYPT31_SQL, JOOMLA_SQL]


@_query("default_scan_documents", _rows(DOCUMENTS, "doc_id", *_DEFAULT_SQL))
def default_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All default detectors over all documents."""
    return _flat(scan(readers.spread(_table(spark, sf_dir, "documents")), ids=["doc_id"]), "doc_id")


@_query("default_scan_pages", _rows("SELECT page_id AS key, html AS t FROM pages", "page_id", *_DEFAULT_SQL))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(scan(readers.spread(_table(spark, sf_dir, "pages")), "html", ["page_id"]), "page_id")


@_query("file_source", "SELECT sha1(c_name) AS payload, count(*) AS n FROM customer GROUP BY c_name")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' digests as lines of text files, read in windows of 1,000 bytes that know nothing of lines."""
    home = lines.folder(spark, "file_source")
    _table(spark, sf_dir, "customer").select(F.concat(F.repeat(F.lit(". "), F.col("c_custkey").cast("int") % 50), F.sha1("c_name"))).write.text(home)
    found = scan(readers.directory(spark, home, "part-*", window=1000), ids=["source"], base_offset="base_offset", last="last", detectors=["sha1"])
    return found.groupBy(F.element_at("payload", 1).alias("payload")).agg(F.count("*").alias("n"))


_LONG = "repeat('some words here' || chr(10), CAST(c_custkey % 97 AS INT)) || 'eyJhbGciOiJub25lIn01.' || repeat({sha256}, CAST(c_custkey % 50 + 1 AS INT)) || '.' || {md5} || chr(10) || 'http://host/' || repeat('p/', CAST(c_custkey % 1500 AS INT)) || 'x' || chr(10) || 'id=' || repeat('v', CAST(c_custkey % 4000 + 1 AS INT)) || chr(10) || repeat('w ', 600) || chr(10)"
_LONG_SQL = f"""WITH t AS (SELECT c_custkey, {_expression(False, _LONG)} AS t, 16 * (c_custkey % 97) AS a, 54 + 64 * (c_custkey % 50 + 1) AS b, 13 + 2 * (c_custkey % 1500) AS c, 4 + c_custkey % 4000 AS d FROM customer)
SELECT c_custkey, 'jwt' AS type, CAST(a AS BIGINT) AS location, CAST(b AS BIGINT) AS size, md5(substr(t, CAST(a + 1 AS BIGINT), CAST(b AS BIGINT))) AS found FROM t
UNION ALL SELECT c_custkey, 'URL', CAST(a + b + 1 AS BIGINT), CAST(c AS BIGINT), md5(substr(t, CAST(a + b + 2 AS BIGINT), CAST(c AS BIGINT))) FROM t
UNION ALL SELECT c_custkey, 'web-cookie', CAST(a + b + c + 2 AS BIGINT), CAST(d AS BIGINT), md5(substr(t, CAST(a + b + c + 3 AS BIGINT), CAST(d AS BIGINT))) FROM t"""


@_query("window_long_matches", _LONG_SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, addresses and cookies of up to 4,000 characters in texts read in windows of 1,000 bytes; the SQL knows where they are."""
    content = _derived_table(spark, sf_dir, _LONG).select("c_custkey", F.col("text").cast("binary").alias("content"))
    parts = pieces.of_content(content, pieces.View, ("c_custkey",), window=1000)
    found = scan(parts, ids=["c_custkey"], base_offset="base_offset", last="last", detectors=["jwt", "URL", "web-cookie"])
    whole = F.when(F.col("type") == "web-cookie", F.concat_ws("=", "payload")).otherwise(F.element_at("payload", 1))
    return found.select("c_custkey", "type", "location", F.col("size").cast("bigint").alias("size"), F.md5(whole).alias("found"))


def _written(spark: SparkSession, sf_dir: str, name: str, line: str) -> str:
    """A folder of text files with a line for each customer."""
    home = lines.folder(spark, name)
    readers.spread(_table(spark, sf_dir, "customer")).select(F.expr(line)).write.text(home)
    return home


_COUNTED = "SELECT sha1(c_name) AS payload, count(*) AS n FROM customer GROUP BY c_name"


@_query("file_records", _COUNTED)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of records of 46 bytes, of which 45 are written out, in ranges of whole records: digests stand across records and ranges."""
    home = _written(spark, sf_dir, "file_records", "substr(' ' || sha1(c_name) || '    ', 1, 45)")
    found = scan(packed.file_records(spark, home, "<45sx", "part-*", window=1000), ids=["source"], base_offset="base_offset", last="last", detectors=["sha1"])
    return found.groupBy(F.element_at("payload", 1).alias("payload")).agg(F.count("*").alias("n"))


@_query("file_wrapped", f"SELECT codec, payload, n FROM ({_COUNTED}), (SELECT unnest(['base64', 'hex']) AS codec)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests in base64 and hex, each after a number of characters that shifts its phase, in files that codecs read in windows."""
    line = "'-- ' || repeat('x', CAST(c_custkey % 4 AS INT)) || base64(cast(' ' || sha1(c_name) || ' ' AS binary)) || ' . ' || repeat('a', CAST(c_custkey % 2 AS INT)) || lower(hex(' ' || sha1(c_name) || ' ')) || ' zz'"
    home = _written(spark, sf_dir, "file_wrapped", line)
    found = codecs.scan_files(spark, home, "part-*", codecs_=["base64", "hex"], window=1000, detectors=["sha1"])
    return found.groupBy("codec", F.element_at("payload", 1).alias("payload")).agg(F.count("*").alias("n"))


@_query("file_lines", "SELECT x AS line, count(*) AS n FROM (SELECT hex(encode('c ' || c_mktsegment || c_custkey)) || CASE c_custkey % 3 WHEN 0 THEN '0D' WHEN 1 THEN 'FFFE' ELSE '' END || '0A' AS x FROM customer) GROUP BY x")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines byte for byte: with a carriage return, with bytes that are no UTF-8, and bare, in windows of 1,000 bytes."""
    home = _written(spark, sf_dir, "file_lines", "'c ' || c_mktsegment || c_custkey || CASE c_custkey % 3 WHEN 0 THEN '\r' WHEN 1 THEN cast(unhex('FFFE') AS string) ELSE '' END")
    rows = readers.lines(spark, home, "part-*", window=1000)
    return rows.groupBy(F.hex(F.encode("text", "ISO-8859-1")).alias("line")).agg(F.count("*").alias("n"))


@_query("memory_image", "SELECT h AS payload, count(*) AS n FROM (SELECT upper(md5(c_name)) AS h FROM customer) GROUP BY h")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests in raw images whose pages are read by ranges of the file."""
    home = _written(spark, sf_dir, "memory_image", "repeat('. ', CAST(c_custkey % 2000 AS INT)) || upper(md5(c_name)) || repeat(' ', CAST(4063 - 2 * (c_custkey % 2000) AS INT))")
    found = pages.verdicts(readers.image_pages(spark, home, "part-*", window=100_000), ids=["vpage"], filters="win")
    return found.groupBy(F.regexp_extract(F.element_at("details", "md5"), "([0-9A-F]{32})", 1).alias("payload")).agg(F.count("*").alias("n"))


@_query("negatives_conversations", "SELECT CAST(0 AS BIGINT) AS n_findings")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests in conversations: there are none."""
    found = scan(_table(spark, sf_dir, "conversations"), ids=["conv_id"], detectors=["sha1", "sha256", "lm", "uuid", "jwt"])
    return found.agg(F.count("*").alias("n_findings"))


@_query("stream_findings", _rows(DOCUMENTS, "doc_id", _digests({"sha1": (40, _boosted(15, 65))})))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan of documents as a stream, run to its end."""
    table = _table(spark, sf_dir, "documents")
    source = spark.readStream.schema(table.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir.rstrip('/')}/documents.parquet*")
    return lines.run_through(_flat(lines.findings(source, "text", ("doc_id",), detectors=["sha1"]), "doc_id"), "stream_findings")
