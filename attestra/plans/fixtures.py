"""Small texts of our own on which the catalogue's queries run; Spark and SQL see the same rows."""

from __future__ import annotations

REPORTS = {
    "good": "## 本月结果\n1. 完成 42 份合同归档，逾期件从 9 份降到 2 份。\n2. 交付培训手册 3 版，覆盖 120 人。\n## 下月计划\n- 10 日前完成台账核对，责任人小周。",
    "loose": "## 本周工作\n推进系统对接。\n配合部门开展调研，积极沟通。\n处理大量咨询，效果良好。\n约 30 人参加了培训。\n成本减半，零投诉。\n接口故障两次。\n## 计划\n推进验收。",
    "stack": "本周开会 5 次，沟通客户 12 人，走访门店 3 家，整理材料 20 份。",
    "private": "联系人电话 13800001111，邮箱 someone@example.com，学号：20240101。\n王老师负责登记。\n节省 3 万元。\n支付 500 元。",
    "rated": "## 目标达成\n自评优秀，按时上班。\n\n## 协作\n达成预期，但项目延期。\n\n## 创新\n待改进，完成率 120%。",
    "boxes": "## 完成情况\n[ ] 资料收齐\n[x] 报送名单\n满意度 95%。",
    "titled": "四月工作总结\n四月工作总结\n写总结太耗时间。\n考核目标：完成 30 场讲座。\n好像有 8 人没签到。",
    "windows\r\n": "#  结果  \r\n交付 2 版手册； 归档 9 份材料！\r\n\r\n#\r\n整理了一些资料\x0b跟进后续",
    "blank": " \n\t\n",
    "nothing": None,
}
PAIR = (
    "## 下月计划\n- 完成食堂消毒记录整改，覆盖 4 个窗口。\n- 上线图书预约系统。\n- 发布实验室安全手册。\n- 组织新生体检复查。",
    "## 本月结果\n食堂消毒记录整改已完成，覆盖 4 个窗口。\n图书预约系统因接口问题暂缓。\n实验室安全通知已发。\n## 下月计划\n- 组织新生体检复查，10 号前完成。",
)
#: Pairs of reports: one of every status, near misses that must not settle, repeated promises, none at all.
PAIRS = {
    "mixed": PAIR,
    "near": (
        "## 下月计划\n- 完成东校区锅炉检修。\n- 完成二号车间培训。\n- 提交设备手册初稿。\n- 完成北门店盘点工作。\n- 完成甲班组家访记录。",
        "## 本月结果\n完成西校区锅炉检修。\n完成三号车间培训。\n提交设备通知初稿。\n完成南门店盘点工作。\n完成乙班组家访记录。",
    ),
    "repeated": (
        "## 工作安排\n- 整理档案室旧卷宗 200 份\n- 整理档案室旧卷宗 200 份。\n下周将完成会议室改造；同时将采购投影设备两台。\n已完成绿化修剪。",
        "## 进展\n整理档案室旧卷宗 200 份。\n会议室改造已完成，通过验收。",
    ),
    "silent": ("## 总结\n本月无事。", "## 总结\n设备运行正常，巡检 30 次。"),
}
#: Labelled sentences: case, mode, text, the types that should fire (twice where they fire twice).
CASES = (
    ("idle", "final", "推进档案数字化工作。", ["动作无结果"]),
    ("idle with result", "final", "推进档案数字化工作并完成验收。", []),
    ("idle with number", "final", "走访社区，推进登记 35 户。", []),
    ("idle in a plan", "final", "## 下周计划\n周五前推进档案数字化工作。", []),
    ("unconfirmed", "gaps", "联系了印刷厂。", ["结果未确认"]),
    ("confirmed", "gaps", "联系了印刷厂，已回复交付日期。", []),
    ("doubted", "gaps", "报名人数好像有 60 人。", ["状态未证实"]),
    ("doubted in final", "final", "报名人数好像有 60 人。", []),
    ("stacked", "final", "组织会议，协调车辆，跟进报修。", ["活动堆砌"]),
    ("stacked with result", "final", "组织会议，协调车辆，跟进报修，问题全部修复。", []),
    ("two activities", "final", "组织会议 2 次，协调车辆 3 次。", []),
    ("vague once", "final", "新增大量会员 300 人。", ["缺具体数字"]),
    ("vague twice", "final", "若干窗口显著改观，排队降到 5 分钟。", ["缺具体数字", "缺具体数字"]),
    ("pseudo", "final", "约 40 人到场。", ["伪精确"]),
    ("pseudo twice", "final", "约 40 人到场，签到 30余 人。", ["伪精确", "伪精确"]),
    ("exact", "final", "40 人到场。", []),
    ("praise", "final", "现场秩序井然，效果良好。", ["空泛评价"]),
    ("unwindowed", "final", "全校零投诉。", ["负向指标缺时间窗"]),
    ("windowed", "final", "本月 30 天内全校零投诉。", []),
    ("ratio", "final", "排队时间减半。", ["比例无基数"]),
    ("ratio with base", "final", "排队时间从 20 分钟减半。", []),
    ("percent", "final", "满意度 97%。", ["口径缺失"]),
    ("percent with caliber", "final", "满意度 97%，统计 210 份问卷。", []),
    ("fullwidth percent", "final", "满意度 ９０％。", ["口径缺失"]),
    ("saving", "final", "全年节省 12 吨水。", ["收益缺口径"]),
    ("saving with base", "final", "用水从 40 吨降低 12 吨。", []),
    ("money", "final", "回款 30 万元。", ["金额缺统计区间"]),
    ("money with period", "final", "本月回款 30 万元。", []),
    ("risk", "final", "配电箱存在隐患。", ["问题没下文"]),
    ("risk followed up", "final", "配电箱存在隐患，电工将于周三更换。", []),
    ("risk denied", "final", "本月 30 天内未发生安全事故。", []),
    ("risk solved", "final", "解决了漏水问题。", []),
    ("loose plan", "final", "## 下周计划\n推进档案数字化。", ["计划缺责任/时限"]),
    ("plan with owner", "final", "## 下周计划\n推进档案数字化，责任人小李。", []),
    ("plan in line", "final", "下周计划：推进档案数字化。", ["计划缺责任/时限"]),
    ("open box", "final", "[ ] 提交名单 20 份", ["残留待办符号"]),
    ("open box among results", "final", "## 本周成绩\n[ ] 提交名单 20 份", ["残留待办符号", "未完成混进成果"]),
    ("ticked box", "final", "[x] 提交名单 20 份", ["残留待办符号"]),
    ("target line", "final", "目标：推进全部接入。", []),
    ("complaint", "final", "写总结太耗时间。", []),
    ("phone", "final", "热线 13912345678 已开通上线。", ["隐私外泄风险"]),
    ("card and id", "final", "账号 6222020200112233445 已登记上线。", ["隐私外泄风险"]),
    ("salary", "final", "月薪 8000 元已发放上线，本月。", ["隐私外泄风险"]),
    ("names warn only", "final", "王老师完成签收。", []),
)
#: Case, promise, candidate, whether the candidate is the true match.
MATCHES = (
    ("menu", "完成食堂菜单公示", "食堂菜单已公示，完成 4 期", 1), ("menu", "完成食堂菜单公示", "完成操场翻新验收", 0),
    ("lamp", "更换走廊照明灯 30 盏", "走廊照明灯更换 30 盏，全部点亮", 1), ("lamp", "更换走廊照明灯 30 盏", "采购打印纸 12 箱", 0),
    ("form", "发布请假流程新表单", "请假流程新表单发布，使用 88 次", 1), ("form", "发布请假流程新表单", "组织消防演练", 0),
    ("none", "签订物业续约合同", "组织消防演练", 0), ("none", "签订物业续约合同", "采购打印纸 12 箱", 0),
)
#: Case, promise, decoy that looks alike but is about something else.
NEAR = (
    ("contract", "提交设备制度初稿", "提交设备通知初稿"),
    ("manual", "发布实验室安全手册", "发布实验室安全通知"),
    ("campus", "完成东校区锅炉检修", "完成西校区锅炉检修"),
)
SCORES = ((1, 0.84, 0.2), (1, 0.55, 0.3), (0, 0.3, 0.28), (0, 0.12, 0.0))
#: A lexicon for the invented Latin prose of the driver's tables: its frequent words and word parts.
LATIN = {
    "ACTION_VERBS": "thon enan erst anly", "RESULT_SIGNALS": "ingti ationt ionen", "VAGUE_QUANTIFIERS": "anst thha onre", "COLLOQUIAL_ACTIONS": "inth ered",
    "UNVERIFIED_MARKERS": "ouea reou", "RISK_SIGNALS": "bletion shth", "FOLLOWUP_SIGNALS": "tiwh erou", "PLAN_SECTION_WORDS": "user", "DEADLINE_SIGNALS": "thor ofer",
    "OWNER_SIGNALS": "handa", "VAGUE_PRAISE": "heble ndis", "NEGATIVE_METRICS": "ensh onwh", "CLICHE": "tionti reth ouou", "ACTIVITY_VERBS": "athe onth hath erin",
    "CALIBER_WORDS": "erha", "BASELINE_WORDS": "enno", "NUM_UNITS": "% items th", "PLAN_WORDS": "user plan", "DEFER_WORDS": "thwa", "DEFER_VERBS": "onov", "FUTURE_MARKERS": "heti onin",
    "CN_NUM_UNITS": "unit", "ENTITY_SUFFIXES": "tion ing", "ENTITY_STOP_PREFIX": "the", "DOC_TYPE_FAMILIES": "", "ENTITY_NOISE_PREFIX": "an", "DOC_TITLE_WORDS": "the",
    "META_COMMENT_WORDS": "thisonth", "RATING_STRONG": "anon", "RATING_MEET": "erer", "RATING_MISS": "stst", "EVID_STRONG": "inin", "EVID_MISS": "eded",
    "META_COMMENT_VERBS": "qxq", "META_COMMENT_TAILS": "zqz", "PERIOD_WORDS": "year",
}
