"""SQL fragments of the checking queries (DuckDB dialect)."""
from __future__ import annotations

from .. import constants as K

READINGS = """readings AS (
  SELECT CASE event_type WHEN 'view' THEN 'pm25' WHEN 'click' THEN 'pm10' WHEN 'purchase' THEN 'no2'
                         WHEN 'error' THEN 'so2' WHEN 'signup' THEN 'co' END AS parameter,
         value,
         CASE WHEN k < 40 THEN 'µg/m³' WHEN k < 55 THEN 'μg/m³' WHEN k < 70 THEN 'ppb' WHEN k < 80 THEN 'ppm'
              WHEN k < 90 THEN 'mg/m³' WHEN k < 95 THEN ' UG/M3 ' END AS unit,
         ts AS date_utc, 'station-' || user_id AS location, event_id AS seq
  FROM (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k FROM events))"""

HOURLY = READINGS + """,
hourly AS (
  SELECT date_trunc('hour', date_utc) AS date_utc, parameter, avg(value) AS value, arg_min(unit, seq) AS unit,
         count(DISTINCT location) || ' stations' AS location
  FROM readings GROUP BY 1, 2)"""

LATEST = READINGS + """,
latest AS (
  SELECT parameter, location, arg_max(value, (date_utc, seq)) AS value,
         arg_max(unit, (date_utc, seq)) FILTER (unit IS NOT NULL) AS unit, max(date_utc) AS date_utc
  FROM readings GROUP BY 1, 2)"""


def index_unit(p="parameter", v="value", u="unit") -> str:
    n = f"lower(trim(coalesce({u}, '')))"
    return f"""CASE WHEN {p} = 'co' THEN
      CASE WHEN {n} IN ('mg/m³', 'mg/m3') THEN {v}
           WHEN {n} = 'ppm' OR ({n} = 'ppb' AND {v} < 100) THEN {v} * 1.145::DOUBLE
           WHEN {n} = 'ppb' THEN {v} * 0.001145::DOUBLE
           ELSE {v} / 1000 END
    ELSE
      CASE WHEN {n} IN ('mg/m³', 'mg/m3') THEN {v} * 1000
           WHEN {n} = 'ppb' THEN {v} * CASE {p} WHEN 'no2' THEN 1.88::DOUBLE WHEN 'so2' THEN 2.62::DOUBLE
                                              WHEN 'o3' THEN 1.96::DOUBLE ELSE 1 END
           WHEN {n} = 'ppm' AND {p} IN ('no2', 'so2', 'o3') THEN {v} * CASE {p} WHEN 'no2' THEN 1.88::DOUBLE
                                              WHEN 'so2' THEN 2.62::DOUBLE ELSE 1.96::DOUBLE END * 1000
           ELSE {v} END
    END"""


def curve(p: str, c: str) -> str:
    b = K.BREAKPOINTS[p]
    whens = [f"WHEN {c} <= 0 THEN 0::DOUBLE"]
    for k in range(1, 7):
        a0, a1 = b[k - 1], b[k]
        i0, i1 = K.INDEX_STEPS[k - 1], K.INDEX_STEPS[k]
        whens.append(f"WHEN {c} <= {a1} THEN ({i1} - {i0})::DOUBLE / ({a1} - {a0})::DOUBLE * ({c} - {a0}::DOUBLE) + {i0}::DOUBLE")
    return f"CASE WHEN {c} IS NULL THEN NULL {' '.join(whens)} ELSE 500::DOUBLE END"


def sub_index(c: str, p: str = "parameter", names=None) -> str:
    names = names or list(K.BREAKPOINTS)
    return f"CASE {p} " + " ".join(f"WHEN '{n}' THEN {curve(n, c)}" for n in names) + " ELSE -1 END"


def band(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} <= 50 THEN 'Good' WHEN {x} <= 100 THEN 'Satisfactory' "
            f"WHEN {x} <= 200 THEN 'Moderate' WHEN {x} <= 300 THEN 'Poor' WHEN {x} <= 400 THEN 'Very Poor' "
            f"ELSE 'Severe' END")


def label(p: str = "parameter") -> str:
    return f"CASE {p} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.LABELS.items()) + f" ELSE upper({p}) END"


def rank_of(p: str = "parameter") -> str:
    return f"coalesce(list_position(['pm25', 'pm10', 'no2', 'so2', 'co', 'o3'], {p}) - 1, 6)"


def text0(x: str) -> str:
    return f"CAST(CAST(round_even({x}, 0) AS BIGINT) AS VARCHAR)"


def text1(x: str) -> str:
    return f"printf('%.1f', round_even({x}, 1))"


def index_rows(source: str, keys: str) -> str:
    """aqi, category and dominant per key from (parameter, value, unit) rows."""
    k = f"{keys}, " if keys else ""
    return f"""SELECT {k} coalesce(max(si) FILTER (si >= 0), 0)::INTEGER AS aqi,
      coalesce({band("max(si) FILTER (si >= 0)")}, 'Unknown') AS category,
      coalesce(arg_max(parameter, (si, -rk)) FILTER (si >= 0), '') AS dominant
    FROM (SELECT *, CAST(round_even({sub_index("c")}, 0) AS INTEGER) AS si, {rank_of()} AS rk
          FROM (SELECT *, {index_unit()} AS c FROM {source})) {"GROUP BY " + keys if keys else ""}"""


STOP_EVAL = "[" + ", ".join(f"'{w}'" for w in K.EVAL_STOP) + "]"
STOP_REL = "[" + ", ".join(f"'{w}'" for w in K.RELEVANCE_STOP) + "]"


def tokens(t: str) -> str:
    return f"regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}_]+')"


def word_set(t: str, stop: str | None = None) -> str:
    base = f"list_distinct({tokens(t)})"
    return f"list_filter({base}, lambda w: NOT list_contains({stop}, w))" if stop else base


def words(t: str) -> str:
    s = rf"regexp_replace({t}, '^\s+|\s+$', '', 'g')"
    return rf"list_filter(string_split_regex({s}, '\s+'), lambda w: w <> '')"


def token_estimate(t: str) -> str:
    return f"greatest(1, CAST(trunc(len({words(t)}) * 1.3::DOUBLE) AS INTEGER))"


def sentences(t: str) -> str:
    marked = rf"regexp_replace(regexp_replace(replace({t}, chr(13), ''), '([.!?])\s+', '\1' || chr(1), 'g'), '\n{{2,}}', chr(1), 'g')"
    return (rf"list_filter(list_transform(string_split({marked}, chr(1)), "
            rf"lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')")


def long_sentences(t: str) -> str:
    marked = rf"regexp_replace({t}, '([.!?])\s+', '\1' || chr(1), 'g')"
    return (rf"list_filter(list_transform(string_split({marked}, chr(1)), "
            rf"lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: length(s) > 10)")


def count_matches(t: str, pattern: str) -> str:
    return f"len(regexp_extract_all({t}, '{pattern}'))"


def topic(t: str) -> str:
    scores = "[" + ", ".join(count_matches(f"lower({t})", p) for _, p in K.TOPICS) + "]"
    names = "[" + ", ".join(f"'{n}'" for n, _ in K.TOPICS) + "]"
    return (f"(SELECT CASE WHEN list_max(s) = 0 THEN 'general' ELSE ({names})[list_position(s, list_max(s))] END "
            f"FROM (SELECT {scores} AS s))")
