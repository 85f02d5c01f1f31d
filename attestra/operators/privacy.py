"""Personal identifiers in work reports: detection of eight kinds and masking of seven."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Family names and titles.
SURNAMES = (
    "张王李赵刘陈杨黄周吴徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤"
)
TITLES = "老师|主任|经理|院长|处长|科长|组长|师傅|工程师|同学"

# Kind, pattern, whether it blocks delivery.
KINDS = (
    ("手机号", r"(?U)(?<!\d)1[3-9]\d{9}(?!\d)", True),
    ("身份证号", r"(?U)(?<!\d)\d{17}[\dXx](?!\d)", True),
    ("银行卡号", r"(?U)(?<!\d)\d{16,19}(?!\d)", True),
    ("邮箱", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", True),
    ("学号", r"(?U)(学号[:：]?\s*)(\d{6,12})", True),
    ("薪资数字", r"(?U)(薪资|工资|年薪|月薪|绩效奖|津贴|待遇)([^，。；\n]{0,6}?)(\d+(?:\.\d+)?\s*(?:万|千)?\s*元?)", True),
    ("第三方称谓姓名", rf"[{SURNAMES}](?:{TITLES})(?![生室务])", False),
    ("敏感事项", r"低保|家庭困难|特困|单亲|残疾|心理(?:健康|问题|测评)|传染病|资助名单|助学贷款", False),
)


def _hits(text: Column, k: int) -> Column:
    kind, pattern, blocking = KINDS[k]
    found = F.when(text.rlike(NEEDS[k]), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return F.transform(
        found,
        lambda m, i: F.struct(
            (i + k * 1_000_000).alias("seq"),
            F.lit(kind).alias("kind"),
            (F.substring(m, 1, 24) if blocking else m).alias("fragment"),
            F.lit(blocking).alias("blocking"),
        ),
    )


#: By kind, what a text must hold for a match; a cheap test before the pattern itself.
NEEDS = (r"\p{Nd}{11}", r"\p{Nd}{17}", r"\p{Nd}{16}", "@", "学号", "[薪资绩津待]", f"(?:{TITLES})", "[低家特单残心传资助]")


def count(text: Column, blocking: bool) -> Column:
    """Hits of the kinds that block delivery, or of the others."""
    one = lambda k: F.when(text.rlike(NEEDS[k]), F.regexp_count(text, F.lit(KINDS[k][1]))).otherwise(0)
    return sum((one(k) for k in range(len(KINDS)) if KINDS[k][2] == blocking), F.lit(0))


def find(text: Column) -> Column:
    """Array of (seq, kind, fragment, blocking), by kind and then place; kinds are independent, so
    overlapping hits are all reported. Blocking fragments are cut to 24 characters."""
    return F.concat(*[_hits(text, k) for k in range(len(KINDS))])


def _steps() -> list[tuple[str, str, int]]:
    """(pattern, replacement, kind) of the masks, in the order in which they apply."""
    stars = {n: "*" * (n - 4) for n in range(6, 20)}
    out = [(r"(?U)(?<!\d)(1[3-9]\d)\d{4}(\d{4})(?!\d)", "$1****$2", 0)]
    out.append((r"(?U)(?<!\d)(\d{2})\d{14}(\d[\dXx])(?!\d)", "$1" + stars[18] + "$2", 1))
    out += [(rf"(?U)(?<!\d)(\d{{2}})\d{{{n - 4}}}(\d{{2}})(?!\d)", "$1" + stars[n] + "$2", 2) for n in range(16, 20)]
    out.append((r"(?:\G|(?<![A-Za-z0-9._%+-]))([A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*+@([A-Za-z0-9.-]+\.[A-Za-z]{2,})", "$1***@$2", 3))
    # The longest run is taken, so twelve digits come first and shorter ones must end there.
    out += [
        (rf"(?U)(学号[:：]?\s*)(\d{{2}})\d{{{n - 4}}}(\d{{2}})" + ("" if n == 12 else r"(?!\d)"), "$1$2" + stars[n] + "$3", 4) for n in range(12, 5, -1)
    ]
    out.append((KINDS[5][1], "$1$2〔略〕", 5))
    out.append((rf"[{SURNAMES}]({TITLES})(?![生室务])", "某$1", 6))
    return out


def _mask(pattern: str, replacement: str, kind: int):
    """A function of (text, n) that applies a mask, where its kind can be at all."""

    def step(f: Column) -> Column:
        done = F.struct(F.regexp_replace(f["text"], pattern, replacement).alias("text"), (f["n"] + F.regexp_count(f["text"], F.lit(pattern))).alias("n"))
        return F.when(f["text"].rlike(NEEDS[kind]), done).otherwise(f)

    return step


def redact(text: Column) -> Column:
    """(text, n): the masked text and the number of replacements. Masks apply one after the other, each to the
    result of those before; sensitive matters are never masked."""
    found = F.array(F.struct(text.alias("text"), F.lit(0).alias("n")))
    for step in _steps():
        found = F.transform(found, _mask(*step))  # each step's input is worked out once, as an element
    return F.get(found, F.lit(0))


def redact_table(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the text masked (null stays null) and ``n_replaced`` added."""
    done = docs.withColumn("_masked", redact(F.col(text)))
    return done.withColumn("n_replaced", F.coalesce("_masked.n", F.lit(0))).withColumn(text, F.col("_masked.text")).drop("_masked")


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, seq, kind, fragment, blocking), a row per hit."""
    hits = docs.select("doc_id", F.explode(find(F.coalesce("text", F.lit("")))).alias("h"))
    return hits.select("doc_id", "h.*")
