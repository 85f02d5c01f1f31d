"""The same computations as SQL for DuckDB, built from the lexicon's word lists.

DuckDB's regular expressions have no lookaround. Where a rule needs one, runs of digits are taken apart
instead, or the fixture texts avoid the case and a test covers it.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from ..functions import text as T
from ..functions.lexicon import Lexicon, alternation
from ..operators import audit as A
from ..operators import privacy as V
from ..operators import reconcile as R

BLANK = r"[\s\x0B\x85\p{Z}]"
STRIPPED = rf"^{BLANK}+|{BLANK}+$"


def quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    """A Java pattern with Unicode classes for RE2; lookaround goes."""
    pattern = re.sub(r"\(\?<?[!=](?:\[[^\]]*\]|[^()\[\]])*\)", "", pattern.replace("(?U)", ""))
    out, inside, at = [], False, 0
    while at < len(pattern):
        two = pattern[at : at + 2]
        if two == r"\Q":
            end = pattern.index(r"\E", at)
            out.append(re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", pattern[at + 2 : end]))
            at = end + 2
            continue
        if two in (r"\d", r"\D", r"\s"):
            out.append({r"\d": r"\p{Nd}", r"\D": r"\P{Nd}", r"\s": r"\s\x0B\x85\p{Z}" if inside else BLANK}[two])
            at += 2
            continue
        if pattern[at] == "\\":
            out.append(two)
            at += 2
            continue
        inside = pattern[at] == "[" or (inside and pattern[at] != "]")
        out.append(pattern[at])
        at += 1
    return "".join(out).replace("*+", "*").replace("++", "+")


def like(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {quote(re2(pattern))})"


def some(x: str, lex: Lexicon, *keys: str) -> str:
    words = [w for k in keys for w in lex[k]]
    return like(x, alternation(words)) if words else "false"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '{STRIPPED}', '', 'g')"


def cut(x: str, pattern: str, least: int) -> str:
    return f"list_filter(list_transform(string_split_regex({x}, {quote(re2(pattern))}), lambda p: {strip('p')}), lambda p: length(p) >= {least})"


def every(x: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({x}, {quote(re2(pattern))}, {group})"


def words_in(x: str, words: Sequence[str]) -> str:
    return f"list_filter([{', '.join(quote(w) for w in words)}], lambda w: contains({x}, w))"


def values(rows: Sequence[Sequence], names: str) -> str:
    """A parenthesised table of constants."""
    cell = lambda x: "NULL" if x is None else quote(x) if isinstance(x, str) else str(x)
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") t({names}))"


def line_ctes(source: str) -> str:
    """CTEs src, ln (doc_id, line_no, line, heading, section)."""
    split = f"string_split_regex(text, {quote(LINES)})"
    return rf"""src AS (SELECT doc_id, coalesce(text, '') AS text FROM {source}),
l0 AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS line_no FROM (SELECT doc_id, list_transform({split}, lambda x: {strip('x')}) AS l FROM src)),
l1 AS (SELECT *, CASE WHEN starts_with(line, '#') THEN {strip("regexp_replace(line, '^[# ]+', '')")} END AS heading FROM l0),
ln AS (SELECT doc_id, line_no::INT AS line_no, line, heading,
  coalesce(last_value(heading IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS section FROM l1)"""


LINES = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\x{2028}\x{2029}]"

FLAGS = ("plan", "action", "result", "num", "followup", "pending", "todo_box", "risk")
ISSUE_FLAGS = ("unverified", "loose", "stacked", "idle", "quantified", "uncalibrated", "saving", "money", "todo", "todo_in_result", "dangling")


def tag_ctes(source: str, lex: Lexicon, mode: str = "final", style: str = "") -> str:
    """CTEs up to tags: a row per sentence with the flags of the rules."""
    actions = ("ACTION_VERBS", "COLLOQUIAL_ACTIONS") if mode == "gaps" else ("ACTION_VERBS",)
    clauses = cut("s", T.CLAUSE_END, 3)
    learning = like("s", A.LEARNING) if style in ("review", "pitch") else "false"
    body = f"regexp_replace(s, {quote(re2(A.PLAN_PREFIX))}, '')"
    return line_ctes(source) + rf""",
ti AS (SELECT doc_id, CASE WHEN length(t) <= 24 AND NOT regexp_matches(t, '[。！？!?；;]') AND {some('t', lex, 'DOC_TITLE_WORDS')} THEN t ELSE '' END AS title
  FROM (SELECT doc_id, arg_min(line, line_no) AS t FROM ln WHERE line != '' AND heading IS NULL GROUP BY doc_id)),
se0 AS (SELECT doc_id, line_no, section, line, unnest(p) AS s, generate_subscripts(p, 1) AS k
  FROM (SELECT *, {cut('line', T.SENTENCE_END, 4)} AS p FROM ln WHERE line != '' AND heading IS NULL)),
se AS (SELECT se0.*, coalesce(title, '') AS title, (row_number() OVER (PARTITION BY doc_id ORDER BY line_no, k) - 1)::INT AS sent_no FROM se0 LEFT JOIN ti USING (doc_id)),
t0 AS (SELECT *,
  CASE WHEN s = title THEN 'title' WHEN {like('s', A.TARGET_PREFIX)} THEN 'target'
    WHEN NOT {like('s', A.WORK_FACT)} AND ({some('s', lex, 'META_COMMENT_WORDS')} OR {like('s', lex.pattern('meta'))}) THEN 'meta' ELSE '' END AS skip,
  {some('section', lex, 'PLAN_SECTION_WORDS')} OR {like('s', A.PLAN_PREFIX)} AS plan,
  {some('s', lex, *actions)} AS action, {some('s', lex, 'RESULT_SIGNALS')} AS result,
  {like('s', lex.pattern('num'))} OR {like('s', lex.pattern('cn_num'))} AS num, {some('line', lex, 'FOLLOWUP_SIGNALS')} AS followup,
  len(list_filter({clauses}, lambda c: {some('c', lex, *actions, 'ACTIVITY_VERBS')}))::INT AS acts,
  len(list_filter({clauses}, lambda c: {some('c', lex, 'RESULT_SIGNALS')}))::INT AS results,
  {like('s', A.PENDING)} AS pending, {like('s', A.PENDING)} OR {like('s', A.DONE)} AS todo_box,
  {some(f"regexp_replace(s, {quote(re2(lex.pattern('risk_negated')))}, '', 'g')", lex, 'RISK_SIGNALS')} AS risk,
  {some('s', lex, 'BASELINE_WORDS')} AS based, {like('s', A.SAVING)} AS saved, {learning} AS learning FROM se),
t1 AS (SELECT *, skip = '' AS live, skip = '' AND NOT plan AND NOT learning AS deliverable FROM t0),
t2 AS (SELECT *, deliverable AND acts >= {A.STACK_MIN} AND results = 0 AS stacked FROM t1),
tags AS (SELECT *,
  {"live AND " + some('s', lex, 'UNVERIFIED_MARKERS') if mode == "gaps" else "false"} AS unverified,
  live AND plan AND action AND NOT ({some(body, lex, 'DEADLINE_SIGNALS')} OR {some(body, lex, 'OWNER_SIGNALS')}) AS loose,
  deliverable AND NOT stacked AND action AND NOT (result OR num) AS idle,
  live AND num AS quantified,
  live AND num AND {like('s', A.PERCENT)} AND NOT {some('s', lex, 'CALIBER_WORDS')} AS uncalibrated,
  CASE WHEN live THEN {words_in('s', lex['VAGUE_QUANTIFIERS'])} ELSE [] END AS vague,
  CASE WHEN live THEN list_transform({every('s', A.PSEUDO)}, lambda x: {strip('x')}) ELSE [] END AS pseudo,
  CASE WHEN live THEN ({words_in('s', lex['VAGUE_PRAISE'])})[1] END AS praise,
  CASE WHEN live AND NOT {like('s', A.WINDOW)} THEN ({words_in('s', lex['NEGATIVE_METRICS'])})[1] END AS unwindowed,
  CASE WHEN live AND NOT based AND {like('s', A.RATIO)} THEN regexp_extract(s, {quote(re2(A.RATIO))}) END AS ratio,
  live AND saved AND NOT based AS saving,
  live AND NOT (saved AND NOT based) AND {like('s', A.MONEY)} AND NOT {some('s', lex, 'PERIOD_WORDS')} AS money,
  live AND todo_box AS todo,
  live AND pending AND {like('section', A.RESULT_SECTION)} AS todo_in_result,
  live AND risk AND NOT followup AS dangling FROM t2)"""


def private_lists() -> list[str]:
    """For each kind, the list of its hits in ``text``."""
    runs = "regexp_extract_all(text, '\\p{Nd}+[Xx]?')"
    digits = "regexp_extract_all(text, '\\p{Nd}+')"
    full = lambda x, p: f"regexp_full_match({x}, '{p}')"
    titled = f"[{V.SURNAMES}](?:{V.TITLES})"
    return [
        f"list_filter({digits}, lambda x: {full('x', '1[3-9]' + chr(92) + 'p{Nd}{9}')})",
        f"list_transform(list_filter({runs}, lambda x: {full('x', chr(92) + 'p{Nd}{17}[Xx]|' + chr(92) + 'p{Nd}{18}[Xx]?')}), lambda x: substr(x, 1, 18))",
        f"list_filter({digits}, lambda x: length(x) BETWEEN 16 AND 19)",
        r"regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')",
        every("text", V.KINDS[4][1]),
        every("text", V.KINDS[5][1]),
        f"regexp_extract_all(regexp_replace(text, '{titled}[生室务]', chr(10), 'g'), '{titled}')",
        f"regexp_extract_all(text, '{V.KINDS[7][1]}')",
    ]


def style_rules(style: str, lex: Lexicon, mode: str, word_limit: int) -> tuple[list[str], int]:
    """(SELECTs of a document's own issues, word limit)."""
    out, limit = [], word_limit or (A.STYLES[style][0] if style in A.STYLES else 0)
    length = f"length(regexp_replace(text, '{BLANK}+', '', 'g'))"
    if style and style not in A.STYLES:
        out.append(f"SELECT doc_id, 15, 0, 0, '文体未知', {quote(style)}, '' FROM src")
    elif style:
        for k, (label, p) in enumerate(A.STYLES[style][1]):
            out.append(f"SELECT doc_id, 15, {k}, 0, '文体缺件', '（全文）', {quote(label)} FROM src WHERE NOT {like('text', p)}")
        for k, (label, p) in enumerate(A.STYLES[style][2]):
            out.append(f"SELECT doc_id, 15, {10 + k}, 0, '文体越界', '命中「' || regexp_extract(text, {quote(re2(p))}) || '」', {quote(label)} FROM src WHERE {like('text', p)}")
    if mode == "final" and limit:
        out.append(f"SELECT doc_id, 18, 0, 0, '超篇幅', '当前 ' || {length} || ' 字，超出目标 {limit} 字', '' FROM src WHERE {length} > {limit}")
    return out, limit


def rating_cte(lex: Lexicon) -> str:
    """CTE rt (doc_id, block_no, text, detail)."""
    first = {k: f"regexp_extract(b, {quote(re2(lex.pattern(k)))})" for k in ("RATING_STRONG", "RATING_MEET", "RATING_MISS", "EVID_MISS")}
    rate = lambda w: f"coalesce(try_cast(regexp_extract(b, {quote(re2(w + r'[^0-9%]{0,6}(\d+(?:\.\d+)?)\s*[%％]'))}, 1) AS DOUBLE) >= 100, false)"
    proof = f"(list_filter({every('b', lex.pattern('EVID_STRONG'))}, lambda h: CASE h WHEN '达成率' THEN {rate('达成率')} WHEN '完成率' THEN {rate('完成率')} ELSE true END))[1]"
    return rf"""b0 AS (SELECT *, sum(CASE WHEN line = '' OR heading IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS block_no FROM ln),
b1 AS (SELECT doc_id, block_no, any_value(section) AS section, string_agg(line, chr(10) ORDER BY line_no) AS b FROM b0 WHERE line != '' AND heading IS NULL GROUP BY ALL),
b2 AS (SELECT *, {first['RATING_STRONG']} AS strong, {first['RATING_MEET']} AS meet, {first['RATING_MISS']} AS miss, {first['EVID_MISS']} AS lack, {proof} AS proof FROM b1),
rt AS (SELECT doc_id, block_no, substr({strip("CASE WHEN section != '' THEN section ELSE b END")}, 1, 34) AS text, CASE
  WHEN strong != '' AND proof IS NULL THEN '自评「' || strong || '」缺少超额证据'
  WHEN meet != '' AND lack != '' THEN '自评「' || meet || '」但同段有「' || lack || '」'
  WHEN miss != '' AND proof IS NOT NULL THEN '自评「' || miss || '」但本段有「' || proof || '」' END AS detail FROM b2)"""


def issue_ctes(source: str, lex: Lexicon, mode: str = "final", style: str = "", word_limit: int = 0) -> str:
    """CTEs up to issues (doc_id, nth, type, text, detail)."""
    flagged = {
        "unverified": (0, "状态未证实"), "uncalibrated": (1, "口径缺失"), "todo_in_result": (7, "未完成混进成果"), "todo": (8, "残留待办符号"),
        "saving": (10, "收益缺口径"), "money": (11, "金额缺统计区间"), "idle": (12, "结果未确认" if mode == "gaps" else "动作无结果"),
        "dangling": (13, "问题没下文"), "loose": (14, "计划缺责任/时限"),
    }
    parts = [f"SELECT doc_id, {k} AS phase, {'-' if k == 0 else ''}sent_no AS pos, 0 AS hit, {quote(kind)} AS type, s AS text, '' AS detail FROM tags WHERE {c}" for c, (k, kind) in flagged.items()]
    parts.append("SELECT doc_id, 3, sent_no, 0, '活动堆砌', s, acts::VARCHAR FROM tags WHERE stacked")
    parts += [f"SELECT doc_id, {k}, sent_no, 0, '{kind}', s, {c} FROM tags WHERE {c} IS NOT NULL" for k, kind, c in ((5, "空泛评价", "praise"), (6, "负向指标缺时间窗", "unwindowed"), (9, "比例无基数", "ratio"))]
    parts += [f"SELECT doc_id, {k}, sent_no, generate_subscripts({c}, 1), '{kind}', s, unnest({c}) FROM tags" for k, kind, c in ((2, "缺具体数字", "vague"), (4, "伪精确", "pseudo"))]
    whole, _ = style_rules(style, lex, mode, word_limit)
    parts += whole
    ctes = tag_ctes(source, lex, mode, style)
    if style == "self-review":
        ctes += ",\n" + rating_cte(lex)
        parts.append("SELECT doc_id, 16, block_no, 0, '等级与证据不符', text, detail FROM rt WHERE detail IS NOT NULL")
    for k, hits in enumerate(private_lists()):
        if V.KINDS[k][2]:
            parts.append(f"SELECT doc_id, 17, {k}, generate_subscripts({hits}, 1), '隐私外泄风险', substr(unnest({hits}), 1, 24), {quote(V.KINDS[k][0])} FROM src")
    return ctes + ",\ni0 AS (" + "\nUNION ALL ".join(parts) + "),\nissues AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY phase, pos, hit))::INT AS nth, type, text, detail FROM i0)"


def metric_ctes(source: str, lex: Lexicon, mode: str = "final", style: str = "", word_limit: int = 0) -> str:
    """CTEs up to metrics."""
    _, limit = style_rules(style, lex, mode, word_limit)
    flags = {"n_idle": "idle", "n_stacked": "stacked", "n_deliverable": "deliverable", "n_quantified": "quantified", "n_loose_plans": "loose", "n_unverified": "unverified",
             "n_dangling": "dangling", "n_savings": "saving", "n_money": "money", "n_todo": "todo", "n_todo_in_results": "todo_in_result", "n_meta_skipped": "skip = 'meta'", "n_target_skipped": "skip = 'target'"}
    counts = ", ".join(f"count(*) FILTER (WHERE {c}) AS {k}" for k, c in flags.items())
    counts += ", sum(len(vague)) AS n_vague, sum(len(pseudo)) AS n_pseudo, count(praise) AS n_praise, count(unwindowed) AS n_unwindowed, count(ratio) AS n_ratios"
    names = [*flags, "n_vague", "n_pseudo", "n_praise", "n_unwindowed", "n_ratios"]
    lists = private_lists()
    sizes = {b: " + ".join(f"len({x})" for x, (_, _, blocking) in zip(lists, V.KINDS, strict=True) if blocking == b) for b in (True, False)}
    caps = ((35, "idle_rate", 0.7), (25, "n_stacked", 12), (24, "n_ratings", 12), (20, "n_vague", 2.5), (15, "n_dangling", 5), (15, "n_cliches", 3), (8, "n_loose_plans", 4),
            (12, "n_pseudo", 3), (16, "n_praise", 4), (9, "n_unwindowed", 3), (12, "n_ratios", 4), (12, "n_savings", 3), (10, "n_todo", 2.5), (20, "n_todo_in_results", 10), (36, "n_style_missing", 12))
    score = "100.0::DOUBLE - greatest(0.0, 15.0 - density)" + "".join(f" - least({c}.0::DOUBLE, {n} * {e}::DOUBLE)" for c, n, e in caps)
    if limit:
        score += f" - greatest(0.0, least(10.0, (word_count - {limit}) / {limit}.0::DOUBLE * 20))"
    out = issue_ctes(source, lex, mode, style, word_limit) + rf""",
m0 AS (SELECT doc_id, {counts} FROM tags GROUP BY doc_id),
m1 AS (SELECT doc_id, count(*) AS n_issues, count(*) FILTER (WHERE type = '文体缺件') AS n_style_missing, count(*) FILTER (WHERE type = '等级与证据不符') AS n_ratings FROM issues GROUP BY doc_id),
m2 AS (SELECT src.doc_id, length(regexp_replace(text, '{BLANK}+', '', 'g'))::INT AS word_count,
  len(list_filter({cut('text', T.SENTENCE_END, 4)}, lambda x: x != coalesce(title, '')))::INT AS sentence_count, len({words_in('text', lex['CLICHE'])})::INT AS n_cliches,
  ({sizes[True]})::INT AS n_private_blocking, ({sizes[False]})::INT AS n_private_warned, {", ".join(f"coalesce({n}, 0)::BIGINT AS {n}" for n in names)},
  coalesce(n_issues, 0)::BIGINT AS n_issues, coalesce(n_style_missing, 0)::INT AS n_style_missing, coalesce(n_ratings, 0)::INT AS n_ratings
  FROM src LEFT JOIN ti USING (doc_id) LEFT JOIN m0 USING (doc_id) LEFT JOIN m1 USING (doc_id)),
m3 AS (SELECT *, round_even((n_idle + n_stacked) / greatest(n_deliverable, 1) * 100, 1) AS idle_rate, round_even(n_quantified / greatest(sentence_count, 1) * 100, 1) AS density FROM m2)"""
    if mode != "final":
        return out + f",\nmetrics AS (SELECT *, {word_limit} AS word_count_target, {limit} AS effective_word_limit FROM m3)"
    return out + f""",
m4 AS (SELECT *, {word_limit} AS word_count_target, {limit} AS effective_word_limit, trunc(greatest(0.0, {score}))::INT AS score FROM m3),
metrics AS (SELECT *, CASE WHEN score >= 75 AND idle_rate < 20 AND n_issues = 0 THEN '可交付' ELSE '需返工' END AS verdict FROM m4)"""


def ranked_cte(top: int = 5) -> str:
    """CTE ranked over issues: what to ask first."""
    impact = lambda part: "CASE type " + " ".join(f"WHEN {quote(k)} THEN {quote(v[part]) if part == 0 else v[part]}" for k, v in A.IMPACT.items()) + f" ELSE {('' + quote('ask')) if part == 0 else 30} END"
    return rf"""p0 AS (SELECT *, {impact(0)} AS kind, {impact(1)} AS weight, substr(regexp_replace(text, '{BLANK}+', '', 'g'), 1, 60) AS key FROM issues),
p1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY weight DESC, nth) AS n1, min(nth) OVER (PARTITION BY doc_id, key) AS first,
  array_to_string(list_sort(list_distinct(list(type) OVER (PARTITION BY doc_id, key))), '/') AS also FROM p0 WHERE kind = 'ask'),
p2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, type ORDER BY first) <= 2 AS within FROM p1 WHERE n1 = 1),
p3 AS (SELECT *, CASE WHEN within AND row_number() OVER (PARTITION BY doc_id, within ORDER BY weight DESC, first) <= {top} THEN 'asked' ELSE 'rest' END AS bucket FROM p2),
p4 AS (SELECT doc_id, bucket, type, text, detail, weight, also, first FROM p3 UNION ALL SELECT doc_id, 'fix', type, text, detail, weight, type, nth FROM p0 WHERE kind = 'fix'),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY CASE bucket WHEN 'asked' THEN 0 WHEN 'rest' THEN 1 ELSE 2 END, CASE WHEN bucket != 'fix' THEN -weight END, first))::INT AS place FROM p4)"""


def asked(x: str = "type", detail: str = "detail") -> str:
    return "CASE " + x + " " + " ".join(f"WHEN {quote(k)} THEN replace({quote(v)}, '%s', {detail})" for k, v in A.ASKS.items()) + " END"


def redacted(source: str) -> str:
    """SELECT doc_id, text, n_replaced of the masked texts of a table."""
    stars = "repeat('*', length(x) - 4)"
    titled = f"[{V.SURNAMES}]({V.TITLES})([^生室务]|$)"
    salary = quote(re2(V.KINDS[5][1]))
    mail = r"([A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*@([A-Za-z0-9.-]+\.[A-Za-z]{2,})"
    return rf"""WITH a AS (SELECT doc_id, regexp_extract_all(text, '\p{{Nd}}+|\P{{Nd}}+') AS p FROM {source}),
b AS (SELECT doc_id, array_to_string(list_transform(p, lambda x, i: CASE
    WHEN regexp_full_match(x, '1[3-9]\p{{Nd}}{{9}}') THEN substr(x, 1, 3) || '****' || substr(x, 8)
    WHEN regexp_full_match(x, '\p{{Nd}}{{17}}') AND regexp_matches(coalesce(p[i + 1], ''), '^[Xx]') THEN substr(x, 1, 2) || repeat('*', 14) || substr(x, 17)
    WHEN regexp_full_match(x, '\p{{Nd}}{{16,19}}') THEN substr(x, 1, 2) || {stars} || substr(x, length(x) - 1) ELSE x END), '') AS text,
  len(list_filter(p, lambda x: regexp_full_match(x, '1[3-9]\p{{Nd}}{{9}}|\p{{Nd}}{{16,19}}'))) AS n FROM a),
c AS (SELECT doc_id, regexp_replace(text, '{mail}', '\1***@\2', 'g') AS text, n + len(regexp_extract_all(text, '{mail}')) AS n FROM b),
d AS (SELECT doc_id, regexp_extract_all(text, '\p{{Nd}}+|\P{{Nd}}+') AS p, n FROM c),
e AS (SELECT doc_id, array_to_string(list_transform(p, lambda x, i: CASE WHEN i > 1 AND regexp_full_match(x, '\p{{Nd}}{{6,}}') AND regexp_matches(p[i - 1], '学号[:：]?{BLANK}*$')
    THEN substr(x, 1, 2) || repeat('*', least(length(x), 12) - 4) || substr(x, least(length(x), 12) - 1) ELSE x END), '') AS text,
  n + len(list_filter(p, lambda x, i: i > 1 AND regexp_full_match(x, '\p{{Nd}}{{6,}}') AND regexp_matches(p[i - 1], '学号[:：]?{BLANK}*$'))) AS n FROM d),
f AS (SELECT doc_id, regexp_replace(text, {salary}, '\1\2〔略〕', 'g') AS text, n + len(regexp_extract_all(text, {salary})) AS n FROM e),
g AS (SELECT doc_id, text AS t0, regexp_replace(regexp_replace(text, '{titled}', '某\1\2', 'g'), '{titled}', '某\1\2', 'g') AS text, n FROM f)
SELECT doc_id, text, (n + len(regexp_extract_all(text, '某(?:{V.TITLES})')) - len(regexp_extract_all(t0, '某(?:{V.TITLES})')))::INT AS n_replaced FROM g"""


def normal(x: str) -> str:
    return f"lower({strip(f'regexp_replace({x}, {quote(re2(T.PUNCTUATION))}, {quote("")}, {quote("g")})')})"


def item_ctes(source: str, lex: Lexicon, plan: bool, name: str) -> str:
    """CTEs up to ``name`` (doc_id, ord, item): commitments or evidence of a table."""
    unbullet = lambda x: f"regexp_replace({x}, {quote(re2(T.BULLET))}, '')"
    heading = lex.pattern("plan_heading")
    ctes = line_ctes(source)
    for c in ("src", "l0", "l1", "ln"):
        ctes = re.sub(rf"\b{c}\b", f"{name}_{c}", ctes)
    kept = "heading IS NULL" if plan else "heading IS NULL OR heading != ''"
    line = "line" if plan else "coalesce(heading, line)"
    ctes += rf""",
{name}_r AS (SELECT doc_id, line_no, section, {line} AS line FROM {name}_ln WHERE line != '' AND ({kept})),
{name}_p AS (SELECT *, {strip(unbullet('line'))} AS body, CASE WHEN line = section THEN {like('line', heading)}
  ELSE {like('section', heading)} OR {like(unbullet('line'), lex.pattern('inline_plan'))} END AS planned FROM {name}_r)"""
    listed = f"SELECT doc_id, line_no::BIGINT * 1000000 AS ord, body AS item FROM {name}_p WHERE {'' if plan else 'NOT '}planned AND length({normal('body')}) >= {R.ITEM_MIN}"
    if not plan:
        return ctes + f",\n{name} AS ({listed})"
    ahead = lambda x: f"({like(x, lex.pattern('FUTURE_MARKERS'))} AND NOT {like(x, R.DONE)})"
    return ctes + rf""",
{name}_s AS (SELECT doc_id, line_no, unnest(p) AS sent, generate_subscripts(p, 1) - 1 AS k FROM (SELECT *, string_split_regex(line, '[。；;！!]') AS p FROM {name}_p WHERE NOT planned AND {ahead('line')})),
{name}_c AS (SELECT doc_id, line_no, k, unnest(p) AS c, generate_subscripts(p, 1) - 1 AS j FROM (SELECT *, string_split_regex({unbullet('sent')}, '{R.COORDINATION}') AS p FROM {name}_s WHERE {ahead('sent')})),
{name}_i AS (SELECT doc_id, line_no::BIGINT * 1000000 + k * 1000 + j AS ord, regexp_replace(c, '^[ ：:，。]+|[ ：:，。]+$', '', 'g') AS item FROM {name}_c),
{name} AS ({listed} UNION ALL SELECT doc_id, ord, item FROM {name}_i WHERE length({normal('item')}) >= {R.PROMISE_MIN})"""


def similarity_ctes(pairs: str, lex: Lexicon, num_match: str, name: str) -> str:
    """CTE ``name``: the pairs (a, b, ta, tb and whatever else) of a query with their score."""
    number = lex.pattern("num") if num_match == "unit" else R.PLAIN_NUMBER
    grams = lambda x, n: f"list_transform(range(1, length({x}) - {n - 2}), lambda i: substr({x}, i, {n}))"
    two = lambda x: f"CASE WHEN length({x}) = 1 THEN [{x}] ELSE {grams(x, 2)} END"
    common = "list_sum(list_transform(list_distinct(ga), lambda g: least(len(list_filter(ga, lambda y: y = g)), len(list_filter(gb, lambda y: y = g)))))"
    return rf"""{name}_0 AS (SELECT *, {normal('ta')} AS na, {normal('tb')} AS nb FROM ({pairs})),
{name}_1 AS (SELECT *, {two('na')} AS ga, {two('nb')} AS gb FROM {name}_0),
{name}_2 AS (SELECT *, coalesce({common}, 0)::DOUBLE AS common, len(ga)::DOUBLE AS za, len(gb)::DOUBLE AS zb FROM {name}_1),
{name} AS (SELECT *, CASE WHEN na = '' OR nb = '' THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, greatest(common / za, 2 * common / (za + zb))
  + CASE WHEN list_has_any({grams('na', 5)}, {grams('nb', 5)}) THEN 0.25::DOUBLE WHEN list_has_any({grams('na', 4)}, {grams('nb', 4)}) THEN 0.10::DOUBLE ELSE 0.0::DOUBLE END
  + CASE WHEN list_has_any({every('ta', number)}, {every('tb', number)}) THEN 0.10::DOUBLE ELSE 0.0::DOUBLE END) END AS score FROM {name}_2)"""


def dedupe_ctes(items: str, lex: Lexicon, num_match: str, name: str) -> str:
    """CTEs (for WITH RECURSIVE) up to ``name``: the kept of the items (doc_id, ord, item) of a CTE."""
    pairs = f"SELECT x.doc_id, x.ord AS a, y.ord AS b, x.item AS ta, y.item AS tb FROM {items} x JOIN {items} y ON x.doc_id = y.doc_id AND y.ord < x.ord"
    return similarity_ctes(pairs, lex, num_match, f"{name}_sim") + rf""",
{name}_c AS (SELECT i.doc_id, i.ord, i.item, row_number() OVER (PARTITION BY i.doc_id ORDER BY i.ord) AS n, coalesce(c, []) AS c FROM {items} i
  LEFT JOIN (SELECT doc_id, a, list(b) AS c FROM {name}_sim WHERE score >= {R.SAME} GROUP BY ALL) s ON s.doc_id = i.doc_id AND s.a = i.ord),
{name}_g AS (SELECT doc_id, 0::BIGINT AS n, []::BIGINT[] AS kept FROM (SELECT DISTINCT doc_id FROM {items})
  UNION ALL SELECT g.doc_id, c.n, CASE WHEN list_has_any(g.kept, c.c) THEN g.kept ELSE list_append(g.kept, c.ord) END FROM {name}_g g JOIN {name}_c c ON c.doc_id = g.doc_id AND c.n = g.n + 1),
{name}_k AS (SELECT doc_id, arg_max(kept, n) AS kept FROM {name}_g GROUP BY doc_id),
{name} AS (SELECT c.doc_id, c.ord, c.item FROM {name}_c c JOIN {name}_k k ON k.doc_id = c.doc_id WHERE list_contains(k.kept, c.ord))"""


def conflict(a: str, b: str, lex: Lexicon) -> str:
    """Why two texts contradict; null if they don't."""
    bare = lambda x: f"regexp_replace({x}, '{BLANK}+', '', 'g')"
    families = lex["DOC_TYPE_FAMILIES"]
    kinds = lambda x: "list_filter([" + ", ".join(f"CASE WHEN {like(x, alternation(f))} THEN {k} END" for k, f in enumerate(families)) + "], lambda k: k IS NOT NULL)"
    named = lambda x: f"array_to_string(list_sort({words_in(x, [w for f in families for w in f])}), '、')"
    noise, stops = alternation(w for w in lex["ENTITY_NOISE_PREFIX"] if w), alternation(lex["ENTITY_STOP_PREFIX"])
    pattern = rf"([一-龥A-Za-z0-9]{{1,4}})({alternation(lex['ENTITY_SUFFIXES'])})"
    bare_name = f"regexp_replace(p, {quote(re2(f'^(?:{noise})+(.)'))}, '\\1')" if noise else "p"
    drop = r"^\d+$" + (f"|(?:{stops})$" if stops else "")

    def entities(x: str) -> str:
        both = f"list_zip(list_transform({every(x, pattern, 1)}, lambda p: {bare_name}), {every(x, pattern, 2)})"
        return f"list_sort(list_distinct(list_transform(list_filter({both}, lambda e: NOT {like('e[1]', drop)}), lambda e: e[1] || e[2])))"

    a, b = bare(a), bare(b)
    apart = lambda x, y: f"len({x}) > 0 AND len({y}) > 0 AND NOT list_has_any({x}, {y})"
    return f"""CASE WHEN {apart(kinds(a), kinds(b))} THEN '文档类型不同：' || {named(a)} || ' ≠ ' || {named(b)}
  WHEN {apart(entities(a), entities(b))} THEN '对象不同：' || array_to_string({entities(a)}, '、') || ' ≠ ' || array_to_string({entities(b)}, '、') END"""


def reconcile_ctes(source: str, lex: Lexicon, num_match: str = "unit") -> str:
    """CTEs (for WITH RECURSIVE) up to recon over pairs (pair_id, prev_text, current_text)."""
    prev, cur = (f"(SELECT pair_id AS doc_id, {c} AS text FROM {source})" for c in ("prev_text", "current_text"))
    out = ",\n".join(
        item_ctes(s, lex, plan, f"{n}0") + ",\n" + dedupe_ctes(f"{n}0", lex, num_match, n) for s, plan, n in ((prev, True, "pr"), (cur, False, "ev"), (cur, True, "rl"))
    )
    for side in ("ev", "rl"):
        pairs = f"SELECT p.doc_id, p.ord, p.item AS ta, e.item AS tb FROM pr p JOIN {side} e ON e.doc_id = p.doc_id"
        out += ",\n" + similarity_ctes(pairs, lex, num_match, f"{side}_x") + rf""",
{side}_t AS (SELECT doc_id, ord, tb, score, row_number() OVER (PARTITION BY doc_id, ord ORDER BY score DESC, tb DESC) AS n FROM {side}_x),
{side}_b AS (SELECT p.doc_id, p.ord, coalesce(x.score, 0.0) AS best, coalesce(x.tb, '') AS matched, coalesce(y.score, 0.0) AS second FROM pr p
  LEFT JOIN {side}_t x ON x.doc_id = p.doc_id AND x.ord = p.ord AND x.n = 1 LEFT JOIN {side}_t y ON y.doc_id = p.doc_id AND y.ord = p.ord AND y.n = 2),
{side}_w AS (SELECT b.*, CASE WHEN matched != '' THEN {conflict('item', 'matched', lex)} END AS why, best >= {R.FLOOR} AND best - second >= {R.LEAD} AS sure FROM {side}_b b JOIN pr USING (doc_id, ord))"""
    return out + rf""",
rc AS (SELECT pr.doc_id, pr.ord, pr.item, e.best AS eb, r.best AS rb, e.matched AS em, r.matched AS rm, e.why AS ew, e.sure AS es, r.sure AND r.why IS NULL AS rs
  FROM pr JOIN ev_w e USING (doc_id, ord) JOIN rl_w r USING (doc_id, ord)),
rs AS (SELECT *, CASE WHEN es AND ew IS NOT NULL THEN 'doubtful' WHEN rs AND rb > eb THEN 'rolled' WHEN es AND {like('em', lex.pattern('defer'))} THEN 'deferred'
  WHEN es THEN 'settled' WHEN eb >= {R.TRACE} OR rb >= {R.TRACE} THEN 'doubtful' ELSE 'missing' END AS status FROM rc),
recon AS (SELECT doc_id AS pair_id, (row_number() OVER (PARTITION BY doc_id ORDER BY ord))::INT AS promise_no, item AS promise, status,
  round_even(CASE WHEN status = 'rolled' THEN rb ELSE eb END, 3) AS score, CASE WHEN status = 'rolled' THEN rm ELSE em END AS matched,
  CASE WHEN status = 'doubtful' THEN ew END AS conflict, CASE WHEN status = 'settled' AND rs THEN rm END AS also_planned FROM rs)"""
