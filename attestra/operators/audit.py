"""The audit: sentences are tagged, tags become issues, issues and counts become a verdict.

All tags of a sentence are columns of one select; issues are one explode of an array of conditional
structs; metrics are one aggregation by document. ``seq`` is the emission order of issues, which
breaks ties when questions are ranked.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexicon import WIDE, Lexicon
from . import privacy

# Activities of a stack, and patterns of the rules.
STACK_MIN = 3
PLAN_PREFIX = r"(?U)^\s*(?:[一二三四五六七八九十下本月季]|后续|下一步|近期)?\s*(?:周|月|季|年)?\s*(?:计划|安排|规划|待办|打算)\s*[:：]\s*"
TARGET_PREFIX = r"(?U)^\s*(考核)?目标(?:值|指标)?\s*[:：]"
WINDOW = (
    r"(?U)(连续|自|截至|本月|本周|本季|全年|过去|近|今年以来|此后|以来)[^，。；]{0,8}(\d+\s*)?(天|日|周|月|年|次|季)"
    r"|(\d+|一|两|三|四|五|六|七|八|九|十)\s*(天|日|周|个月|月|年|季度)(?:内|以内|里|间)?"
)
PERCENT = r"(?U)\d+(?:\.\d+)?\s*(?:%|％)"
PSEUDO = r"(?U)(?<![已预约])(?:约|大约|约莫|将近)\s*\d[\d.]*(?!\s*[/月])|\d[\d.]*\s*(?:余|多)(?![数目数])|\d[\d.]*\s*(?:左右|以上|以下)|十来|好几|数十|上百"
RATIO = r"减半|翻倍|翻番|腰斩|番一倍|[一二两三四五六七八九十]+\s*成(?!交)"
SAVING = r"(?U)(?:节省|省了|省下|节约|压缩|降低|减少)\D{0,8}?\d"
MONEY = r"(?U)\d+(?:\.\d+)?\s*(?:万元|亿元|元)"
PENDING, DONE = r"(?U)^\s*[-*]?\s*\[[ ]\]", r"(?U)^\s*[-*]?\s*\[[xX]\]"
RESULT_SECTION = "结果|成绩|交付|产出|完成|亮点|业绩"
LEARNING = r"判断规则|我的判断|规则是|教训是|我学到|下次同类|反思"
WORK_FACT = r"(?U)\d|[份个数人次元条间]"
# Fixed values. Style: word limit, required (label, pattern), forbidden (label, pattern).
STYLES = {
    "weekly": (500, [("结果小节", "结果|交付|产出|完成"), ("下期计划", "计划|下一步|下周|待办")], [("方法论与成长反思", "方法论|经验沉淀|复盘思考|个人成长|心得")]),
    "monthly": (1500, [("目标达成度", "目标|KPI|OKR|达成|完成率"), ("对比轴", "同比|环比|较上月|上月|完成率|达成|目标值")], []),
    "review": (2500, [("带数字的战役", r"(?U)\d"), ("不足与改进", "不足|反思|改进|没做好|遗憾|教训")], [("目录式背景", "目录|第一章|背景综述")]),
    "self-review": (1000, [("达成率", "达成率|完成率|达成|超额"), ("目标对照", "目标|指标|实际")], [("情绪化诉求", "加班很多|很辛苦|尽了全力|不容易|任劳任怨")]),
    "pitch": (3500, [("量化证据", r"(?U)\d"), ("上任动作", r"(?U)上任|第一周|首月|前三十|30\s*天|90\s*天|我会先|接下来我")], [("空表态", "努力学习|积极配合|不辜负|尽力而为|不负众望")]),
}
# Fixed values. Issue type: who acts on it and its weight; others are ("ask", 30).
IMPACT = {
    "状态未证实": ("ask", 95), "未完成混进成果": ("ask", 90), "等级与证据不符": ("ask", 88), "结果未确认": ("ask", 80),
    "动作无结果": ("ask", 80), "收益缺口径": ("ask", 75), "金额缺统计区间": ("ask", 72), "口径缺失": ("ask", 75),
    "比例无基数": ("ask", 70), "问题没下文": ("ask", 65), "伪精确": ("ask", 60), "活动堆砌": ("ask", 55),
    "缺具体数字": ("ask", 50), "空泛评价": ("ask", 45), "计划缺责任/时限": ("ask", 40), "负向指标缺时间窗": ("fix", 30),
    "残留待办符号": ("fix", 20), "超篇幅": ("fix", 15), "隐私外泄风险": ("fix", 10), "文体缺件": ("fix", 10),
    "文体越界": ("fix", 5), "文体未知": ("fix", 5),
}
#: What to ask about an issue; ``%s`` is its detail.
ASKS = {
    "状态未证实": "这件事核实过吗？结果到底如何？",
    "口径缺失": "百分比的分子、分母和统计时间是什么，与谁比较？",
    "缺具体数字": "「%s」具体是多少？查不到就说明原因和替代口径。",
    "活动堆砌": "并列了 %s 个动作却没有产出，哪一项带来了变化？",
    "伪精确": "「%s」是实测还是估算？估算请写明算法。",
    "空泛评价": "「%s」有什么可核对的依据？",
    "负向指标缺时间窗": "「%s」对应哪段统计区间？",
    "未完成混进成果": "这一项尚未完成，应移到进行中或风险。",
    "残留待办符号": "正文不应保留勾选框，请改写成结果或带时限的事项。",
    "比例无基数": "「%s」的基数是多少？",
    "收益缺口径": "节省或降低的基数、区间和算法是什么？",
    "金额缺统计区间": "这笔金额对应哪段时间、什么口径？",
    "结果未确认": "这件事的产出物是什么？",
    "动作无结果": "这件事最后有什么结果？",
    "问题没下文": "谁负责、下一步是什么、需要谁决定？",
    "计划缺责任/时限": "什么时候完成、由谁负责？",
    "文体未知": "支持的文体：" + "/".join(STYLES),
    "文体缺件": "这种文体缺少：%s。",
    "文体越界": "这种文体不应有：%s。",
    "等级与证据不符": "%s",
    "隐私外泄风险": "正文含有%s，请脱敏或改成群体描述。",
    "超篇幅": "删去过程描述，保留结果和影响。",
}


@dataclass
class Audit:
    """Frames by document: tagged sentences, issues (doc_id, seq, type, text, detail, ask), metrics."""

    sentences: DataFrame
    issues: DataFrame
    metrics: DataFrame


def tag(docs: DataFrame, lex: Lexicon, mode: str = "final", style: str = "", kept: dict[str, Column] | None = None) -> DataFrame:
    """Sentences with their tags. ``live`` sentences are those that the rules judge.

    A document's sentences are taken apart inside its row, and a document without any gives one row without tags.
    ``kept`` are further columns, worked out once for a document.
    """
    found = T.sentences_in(F.col("_flat"), lambda line: lex.any(line, "FOLLOWUP_SIGNALS"))
    title = T.title_of(F.col("_flat"), lambda line: lex.any(line, "DOC_TITLE_WORDS"))
    df = docs.withColumn("_flat", T.flat(F.col("text"))).select("doc_id", title.alias("title"), found.alias("_found"), F.col("text"))
    df = df.select("doc_id", "title", "_found", *[c.alias(k) for k, c in (kept or {}).items()])
    df = df.select("*", F.posexplode_outer("_found").alias("sent_no", "_f")).drop("_found")
    df = df.select("*", F.col("_f.section").alias("section"), F.col("_f.mark").alias("followup"), F.col("_f.s").alias("s")).drop("_f")
    s, section = F.col("s"), F.col("section")
    actions = ("ACTION_VERBS", "COLLOQUIAL_ACTIONS") if mode == "gaps" else ("ACTION_VERBS",)
    pool = T.clauses_of(s)
    meta = ~s.rlike(WORK_FACT) & (lex.any(s, "META_COMMENT_WORDS") | s.rlike(lex.pattern("meta")))
    # Most patterns need a wide character, and a Latin sentence has none.
    wide = s.rlike(WIDE)
    df = df.withColumns(
        {
            "skip": F.when(s == F.col("title"), "title").when(wide & s.rlike(TARGET_PREFIX), "target").when(meta, "meta").otherwise(""),
            "plan": lex.any(section, "PLAN_SECTION_WORDS") | (wide & s.rlike(PLAN_PREFIX)),
            "action": lex.any(s, *actions),
            "result": lex.any(s, "RESULT_SIGNALS"),
            "num": s.rlike(r"(?U)\d") & s.rlike(lex.pattern("num")) | (wide & s.rlike(lex.pattern("cn_num"))),
            # Clauses matter only where the sentence has an activity at all.
            "acts": F.when(lex.any(s, *actions, "ACTIVITY_VERBS"), F.size(F.filter(pool, lambda c: lex.any(c, *actions, "ACTIVITY_VERBS")))).otherwise(0),
            "results": F.when(lex.any(s, "RESULT_SIGNALS"), F.size(F.filter(pool, lambda c: lex.any(c, "RESULT_SIGNALS")))).otherwise(0),
            "pending": s.rlike(PENDING),
            "todo": s.rlike(PENDING) | s.rlike(DONE),
            "risk": lex.any(s, "RISK_SIGNALS") & lex.any(F.when(wide, F.regexp_replace(s, lex.pattern("risk_negated"), "")).otherwise(s), "RISK_SIGNALS"),
        }
    )
    learning = s.rlike(LEARNING) if style in ("review", "pitch") else F.lit(False)
    based, body = lex.any(s, "BASELINE_WORDS"), F.regexp_replace(s, PLAN_PREFIX, "")
    there = s.isNotNull()
    df = df.withColumns({"live": there & (F.col("skip") == ""), "deliverable": there & (F.col("skip") == "") & ~F.col("plan") & ~learning})
    stacked = F.col("deliverable") & (F.col("acts") >= STACK_MIN) & (F.col("results") == 0)
    live, saving = F.col("live"), wide & s.rlike(SAVING) & ~based
    tags = df.withColumns(
        {
            "unverified": live & lex.any(s, "UNVERIFIED_MARKERS") if mode == "gaps" else F.lit(False),
            "loose": live & F.col("plan") & F.col("action") & ~(lex.any(body, "DEADLINE_SIGNALS") | lex.any(body, "OWNER_SIGNALS")),
            "stacked": stacked,
            "idle": F.col("deliverable") & ~stacked & F.col("action") & ~(F.col("result") | F.col("num")),
            "quantified": live & F.col("num"),
            "uncalibrated": live & F.col("num") & s.rlike(PERCENT) & ~lex.any(s, "CALIBER_WORDS"),
            "vague": F.when(live & lex.any(s, "VAGUE_QUANTIFIERS"), lex.hits(s, "VAGUE_QUANTIFIERS")),
            "pseudo": F.when(live & wide & s.rlike(PSEUDO), F.transform(F.regexp_extract_all(s, F.lit(PSEUDO), F.lit(0)), T.strip)),
            "praise": F.when(live & lex.any(s, "VAGUE_PRAISE"), F.get(lex.hits(s, "VAGUE_PRAISE"), F.lit(0))),
            "unwindowed": F.when(live & lex.any(s, "NEGATIVE_METRICS") & ~s.rlike(WINDOW), F.get(lex.hits(s, "NEGATIVE_METRICS"), F.lit(0))),
            "ratio": F.when(live & wide & s.rlike(RATIO) & ~based, F.regexp_extract(s, RATIO, 0)),
            "saving": live & saving,
            "money": live & wide & ~saving & s.rlike(MONEY) & ~lex.any(s, "PERIOD_WORDS"),
            "todo": live & F.col("todo"),
            "todo_in_result": live & F.col("pending") & section.rlike(RESULT_SECTION),
            "dangling": live & F.col("risk") & ~F.col("followup"),
        }
    )
    return tags.select("*", _count_of(tags).alias("n_tagged"))


def _count_of(tags: DataFrame) -> Column:
    """Issues of a sentence."""
    one = ("unverified", "uncalibrated", "stacked", "todo_in_result", "todo", "saving", "money", "idle", "dangling", "loose")
    out = sum((F.coalesce(F.col(c), F.lit(False)).cast("int") for c in one), F.lit(0))
    out = sum((F.col(c).isNotNull().cast("int") for c in ("praise", "unwindowed", "ratio")), out)
    return sum((F.coalesce(F.size(c), F.lit(0)) * F.col(c).isNotNull().cast("int") for c in ("vague", "pseudo")), out)


def _issue(phase: int, kind: str, order: Column, text: Column, detail: Column | None = None) -> Column:
    return F.struct(
        F.lit(phase).alias("phase"), order.cast("long").alias("at"), F.lit(kind).alias("type"), text.alias("text"), (F.lit("") if detail is None else detail).alias("detail")
    )


def _each(phase: int, kind: str, at: Column, text: Column, details: Column) -> Column:
    return F.transform(details, lambda x, i: _issue(phase, kind, at + i, text, x))


def _sentence_issues(tags: DataFrame, mode: str) -> DataFrame:
    s = F.col("s")
    at = F.col("sent_no").cast("long") * 1_000_000
    one = {
        0: ("状态未证实", "unverified", -at, None),
        1: ("口径缺失", "uncalibrated", at, None),
        3: ("活动堆砌", "stacked", at, F.col("acts").cast("string")),
        7: ("未完成混进成果", "todo_in_result", at, None),
        8: ("残留待办符号", "todo", at, None),
        10: ("收益缺口径", "saving", at, None),
        11: ("金额缺统计区间", "money", at, None),
        12: ("结果未确认" if mode == "gaps" else "动作无结果", "idle", at, None),
        13: ("问题没下文", "dangling", at, None),
        14: ("计划缺责任/时限", "loose", at, None),
    }
    parts = [F.when(F.col(c), F.array(_issue(k, kind, order, s, detail))) for k, (kind, c, order, detail) in one.items()]
    named = {5: ("空泛评价", "praise"), 6: ("负向指标缺时间窗", "unwindowed"), 9: ("比例无基数", "ratio")}
    parts += [F.when(F.col(c).isNotNull(), F.array(_issue(k, kind, at, s, F.col(c)))) for k, (kind, c) in named.items()]
    listed = {2: ("缺具体数字", "vague"), 4: ("伪精确", "pseudo")}
    parts += [_each(k, kind, at, s, F.col(c)) for k, (kind, c) in listed.items()]
    nothing = F.array().cast("array<struct<phase:int,at:bigint,type:string,text:string,detail:string>>")
    every = F.concat(*[F.coalesce(p, nothing) for p in parts])
    return tags.select("doc_id", F.explode(every).alias("i")).select("doc_id", "i.*")


def _rating(block: Column, section: Column, lex: Lexicon) -> Column:
    """(text, detail) of a block whose self-rating its evidence does not bear; else null."""
    first = {k: F.regexp_extract(block, lex.pattern(k), 0) for k in ("RATING_STRONG", "RATING_MEET", "RATING_MISS", "EVID_MISS")}
    rates = {w: F.regexp_extract(block, rf"(?U){w}[^0-9%]{{0,6}}(\d+(?:\.\d+)?)\s*[%％]", 1) for w in ("达成率", "完成率")}
    full = {w: F.coalesce(F.try_to_number(r, F.lit("9999999999.999999")) >= 100, F.lit(False)) & (r != "") for w, r in rates.items()}
    hits = F.regexp_extract_all(block, F.lit(lex.pattern("EVID_STRONG")), F.lit(0))
    proof = F.get(F.filter(hits, lambda h: F.when(h == "达成率", full["达成率"]).when(h == "完成率", full["完成率"]).otherwise(F.lit(True))), F.lit(0))
    strong, meet, miss, lack = (first[k] for k in ("RATING_STRONG", "RATING_MEET", "RATING_MISS", "EVID_MISS"))
    detail = (
        F.when((strong != "") & proof.isNull(), F.concat(F.lit("自评「"), strong, F.lit("」缺少超额证据")))
        .when((meet != "") & (lack != ""), F.concat(F.lit("自评「"), meet, F.lit("」但同段有「"), lack, F.lit("」")))
        .when((miss != "") & proof.isNotNull(), F.concat(F.lit("自评「"), miss, F.lit("」但本段有「"), proof, F.lit("」")))
    )
    where = F.substring(T.strip(F.when(section != "", section).otherwise(block)), 1, 34)
    return F.struct(where.alias("text"), detail.alias("detail"))


def ratings(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """Self-ratings that their own block's evidence does not bear: (doc_id, phase, at, type, text, detail)."""
    found = docs.select("doc_id", F.posexplode(T.blocks_of(T.flat(F.col("text")))).alias("block_no", "b"))
    found = found.select("doc_id", "block_no", _rating(F.col("b.block"), F.col("b.section"), lex).alias("r")).where("r.detail IS NOT NULL")
    return found.select("doc_id", _issue(16, "等级与证据不符", F.col("block_no"), F.col("r.text"), F.col("r.detail")).alias("i")).select("doc_id", "i.*")


def audit(docs: DataFrame, lex: Lexicon, mode: str = "final", style: str = "", word_limit: int = 0) -> Audit:
    """Audit every document of docs(doc_id, text); a null text is an empty one. doc_id identifies a
    document.

    Each of the three frames is one pass over the texts, which are never shuffled; only counts are, one row for
    each document and task.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    text, words = F.col("text"), T.cn_len(F.col("text"))
    limit = word_limit or (STYLES[style][0] if style in STYLES else 0)
    whole: list[Column] = []  # issues of a whole document, each null where there is none
    if style and style not in STYLES:
        whole.append(_issue(15, "文体未知", F.lit(0), F.lit(style)))
    elif style:
        _, required, forbidden = STYLES[style]
        whole += [F.when(~text.rlike(p), _issue(15, "文体缺件", F.lit(k), F.lit("（全文）"), F.lit(label))) for k, (label, p) in enumerate(required)]
        whole += [
            F.when(text.rlike(p), _issue(15, "文体越界", F.lit(10 + k), F.concat(F.lit("命中「"), F.regexp_extract(text, p, 0), F.lit("」")), F.lit(label)))
            for k, (label, p) in enumerate(forbidden)
        ]
    if mode == "final" and limit:
        over = F.concat(F.lit("当前 "), words.cast("string"), F.lit(f" 字，超出目标 {limit} 字"))
        whole.append(F.when(words > limit, _issue(18, "超篇幅", F.lit(0), over)))
    rated = T.blocks_of(T.flat(text)) if style == "self-review" else None
    kept = {
        "word_count": words,
        "sentence_count": F.size(F.filter(T.sentences_of(text), lambda s: s != F.col("title"))),
        "n_cliches": F.when(lex.any(text, "CLICHE"), F.size(lex.hits(text, "CLICHE"))).otherwise(0),
        "n_private_blocking": privacy.count(text, True),
        "n_private_warned": privacy.count(text, False),
        "n_style_missing": sum((F.when(~text.rlike(p), 1).otherwise(0) for _, p in STYLES[style][1]), F.lit(0)) if style in STYLES else F.lit(0),
        "n_ratings": F.size(F.filter(F.transform(rated, lambda b: _rating(b["block"], b["section"], lex)), lambda r: r["detail"].isNotNull())) if style == "self-review" else F.lit(0),
        "n_whole": sum((w.isNotNull().cast("int") for w in whole), F.lit(0)),
    }
    tags = tag(docs, lex, mode, style, kept)
    parts = [_sentence_issues(tags, mode)]
    if whole:
        parts.append(docs.select("doc_id", F.explode(F.filter(F.array(*whole), lambda r: r.isNotNull())).alias("i")).select("doc_id", "i.*"))
    if style == "self-review":
        parts.append(ratings(docs, lex))
    private = docs.select("doc_id", F.explode(privacy.find(text)).alias("h")).where("h.blocking")
    parts.append(private.select("doc_id", _issue(17, "隐私外泄风险", F.col("h.seq"), F.col("h.fragment"), F.col("h.kind")).alias("i")).select("doc_id", "i.*"))
    issues = parts[0]
    for p in parts[1:]:
        issues = issues.unionByName(p)
    asks = F.create_map(*[F.lit(x) for pair in ASKS.items() for x in pair])
    issues = issues.withColumn("ask", F.replace(asks[F.col("type")], F.lit("%s"), F.col("detail")))
    issues = issues.select("doc_id", F.struct("phase", "at").alias("seq"), "type", "text", "detail", "ask")
    return Audit(tags.where("s IS NOT NULL"), issues, _metrics(tags, list(kept), mode, word_limit, limit))


def _metrics(tags: DataFrame, kept: list[str], mode: str, word_limit: int, limit: int) -> DataFrame:
    flagged = {
        "n_idle": "idle", "n_stacked": "stacked", "n_deliverable": "deliverable", "n_quantified": "quantified", "n_loose_plans": "loose",
        "n_unverified": "unverified", "n_dangling": "dangling", "n_savings": "saving", "n_money": "money", "n_todo": "todo",
        "n_todo_in_results": "todo_in_result",
    }
    counts = [F.first(k).alias(k) for k in kept]
    counts += [F.count_if(F.col(c)).alias(k) for k, c in flagged.items()]
    counts += [F.count_if(F.col("s").isNotNull() & (F.col("skip") == kind)).alias(f"n_{kind}_skipped") for kind in ("meta", "target")]
    counts += [F.sum(F.when(F.col(c).isNotNull(), F.size(c)).otherwise(0)).alias(k) for k, c in (("n_vague", "vague"), ("n_pseudo", "pseudo"))]
    counts += [F.count(c).alias(k) for k, c in (("n_praise", "praise"), ("n_unwindowed", "unwindowed"), ("n_ratios", "ratio"))]
    df = tags.groupBy("doc_id").agg(*counts, F.sum("n_tagged").alias("_tagged"))
    df = df.withColumn("n_issues", F.col("_tagged") + F.col("n_whole") + F.col("n_ratings") + F.col("n_private_blocking")).drop("_tagged", "n_whole")
    df = df.withColumns(
        {
            "idle_rate": F.bround((F.col("n_idle") + F.col("n_stacked")) / F.greatest("n_deliverable", F.lit(1)) * 100, 1),
            "density": F.bround(F.col("n_quantified") / F.greatest("sentence_count", F.lit(1)) * 100, 1),
            "word_count_target": F.lit(word_limit),
            "effective_word_limit": F.lit(limit),
        }
    )
    if mode != "final":
        return df
    # Cap, count and points off for each.
    caps = (
        (35, "idle_rate", 0.7), (25, "n_stacked", 12), (24, "n_ratings", 12), (20, "n_vague", 2.5), (15, "n_dangling", 5),
        (15, "n_cliches", 3), (8, "n_loose_plans", 4), (12, "n_pseudo", 3), (16, "n_praise", 4), (9, "n_unwindowed", 3), (12, "n_ratios", 4),
        (12, "n_savings", 3), (10, "n_todo", 2.5), (20, "n_todo_in_results", 10), (36, "n_style_missing", 12),
    )
    score = F.lit(100.0) - F.greatest(F.lit(0.0), F.lit(15.0) - F.col("density"))
    for cap, name, each in caps:
        score = score - F.least(F.lit(float(cap)), F.col(name) * each)
    if limit:
        score = score - F.greatest(F.lit(0.0), F.least(F.lit(10.0), (F.col("word_count") - limit) / F.lit(limit) * 20))
    df = df.withColumn("score", F.greatest(F.lit(0.0), score).cast("int"))
    good = (F.col("score") >= 75) & (F.col("idle_rate") < 20) & (F.col("n_issues") == 0)
    return df.withColumn("verdict", F.when(good, "可交付").otherwise("需返工"))
