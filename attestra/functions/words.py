"""Word lists of the default lexicon and of its profiles."""

# The words that the audit and reconciliation rules look for, used under the MIT licence.
BASE = {
    "ACTION_VERBS": "推进 开展 完成 负责 参与 跟进 组织 协调 优化 支持 配合 落实 推动 梳理 对接 支撑 保障 加强 提升 打造 建设 维护 处理 沟通 安排 执行 协助 承接 牵头 主导 部署 运营 招新 拜访".split(),
    "RESULT_SIGNALS": "上线 交付 通过 达成 完成 发布 落地 结项 验收 转正 中标 签约 拿到 获得 减少 降低 缩短 提高 增长 翻 零事故 零投诉 无返工 一次通过 提前 按期 节省 挽回 覆盖 转化 留存 复购 闭环 已解决 归档 获批 评审通过 投产 达产 开业 招生 录取 无复现 不复现 归零 修复 恢复正常 回签 签认 收讫 办结 回复 答复 回函 已反馈".split(),
    "VAGUE_QUANTIFIERS": "大量 若干 多次 一定 明显 大幅 显著 部分 基本 较多 较少 一定程度 有效 积极 深入 全面 切实 稳步 有序 顺利 进一步 很多 不少 诸多 极大 好多 挺多 老多 一些 还行 挺好 挺快 还好 好一些 差不多".split(),
    "COLLOQUIAL_ACTIONS": "弄 搞 催 联系 教 核对 整理 发 收 盯 跑 找 问 处理 准备 写 安排 沟通 对接 通知 报送".split(),
    "UNVERIFIED_MARKERS": "应该 好像 反正 大概 貌似 估计 据说 不确定 不知道 可能 差不多 大致 没数清 没统计 没留底 记不清 没算过 没记数 说不清具体".split(),
    "RISK_SIGNALS": "延期 阻塞 卡 故障 客诉 投诉 风险 等待 依赖 不足 缺口 瓶颈 遗留 历史问题 超期 逾期 返工 报错 宕机 掉线 流失 不达标 未通过 被拒 争议 隐患 异常 待办事项 未闭环 发现问题 存在问题 遗留问题 问题未整改 待整改".split(),
    "FOLLOWUP_SIGNALS": "下周 下阶段 计划 拟 将于 预计 责任人 由 需要 申请 已提交 已上报 待 解决方案 下一步 需 已 建议 确认 决定 承诺 责任 派单 报请 约".split(),
    "PLAN_SECTION_WORDS": "计划 下一步 下周 待办 安排 规划 roadmap".split(),
    "DEADLINE_SIGNALS": "下周 本周 月底 日前 号前 前完成 之前 截止 周内 月内 季度 周一 周二 周三 周四 周五 v1 V1 首次 立即".split(),
    "OWNER_SIGNALS": "责任人 由我 由本人 我负责 牵头 对接人 支持方 需 申请".split(),
    "VAGUE_PRAISE": "效果良好 效果不错 效果显著 反响热烈 反馈良好 反馈不错 一致好评 好评如潮 得到认可 获得认可 受到好评 大家表示满意 顺利完成 圆满结束 圆满达成 反应积极 评价较高 获得一致好评".split(),
    "NEGATIVE_METRICS": "零事故 零投诉 零差错 零故障 无复现 无差错 无返工 未发生 无一例 零安全责任 无重大".split(),
    "CLICHE": "赋能 抓手 闭环 颗粒度 打法 心智 势能 链路 矩阵 组合拳 顶层设计 底层逻辑 降本增效 提质增效 高质量发展 全力以赴 多措并举 行稳致远 新质 沉淀 对齐 拉通 聚焦 在领导的正确指导下 在公司的大力支持下 圆满完成了各项工作任务".split(),
    "ACTIVITY_VERBS": "开会 参会 参加 列席 沟通 对接 协调 走访 巡查 巡检 填写 填报 输出 整理 转发 接待 值班 值守 宣讲 答疑 排查 报送 跟进 催办 组织 参与 处理 支持 配合 安排 汇报 传达 布置 收集 汇总 录入 派单 受理".split(),
    "CALIBER_WORDS": "同比 环比 较上月 较去年 全年 季度 月度 自 截至 从 到 基线 目标 口径 统计".split(),
    "BASELINE_WORDS": "从 到 较 由 原来 此前 之前 同比 环比 基线 去年同期 上月 原本 改造前 调整前".split(),
    "NUM_UNITS": "人次 课时 小时 分钟 个百分点 批次 % ％ 万 亿 千 元 人 个 次 天 条 份 台 家 单 页 篇 名 倍 项 节 起 处 场 轮 门 课 例 件 户 套 间 栋 座 周 月 年 批 张 遍 步 版 字 分".split(),
    "PLAN_WORDS": "计划 下一步 下周 待办 安排 规划 打算".split(),
    "DEFER_WORDS": "推迟 顺延 暂缓 搁置 延后 先不 暂时 暂停 再说 待定 还没 取消 不了了之 尚未".split(),
    "DEFER_VERBS": "完成 办成 做成 做完 启动 开始 上线 落地 交付 举办 推进 发放 收齐 落实 开展".split(),
    "FUTURE_MARKERS": "下季度 下一季度 下个季度 明年 下一步 我打算 打算 拟 将要 计划要 准备 待启动 接下来我 力争 争取".split(),
    "CN_NUM_UNITS": "成 倍 次 项 个 人 天 场 轮 起 处 条 份 元 万元 小时 页 篇 名 家 单 门 节课 周 月 年 版 户 套 件".split(),
    "ENTITY_SUFFIXES": "学院 校区 系 楼 中心 科室 车间 门店 班组".split(),
    "ENTITY_STOP_PREFIX": "个 两 各 每 这 那 若干 全部 所有 两所 多个 其余".split(),
    "DOC_TYPE_FAMILIES": [("手册", "指引", "规程", "操作说明"), ("办法", "制度", "细则", "规定"), ("流程", "工序", "审批流"), ("表格", "清单", "对照表", "台账"), ("通知", "公告", "通报"), ("系统", "平台"), ("方案", "计划书"), ("报告", "总结", "纪要")],
    "ENTITY_NOISE_PREFIX": "完成 推动 组织 更新 复检 对接 通知 安排 落实 实施 开展 发给 发送 上报 协调 负责 参与 支持 配合 处理 跟进 梳理 在 向 对 与 和 该 这 各 已 经 将 请 约 复".split(),
    "DOC_TITLE_WORDS": "随手记 杂记 笔记 记录 清单 草稿 素材 备忘 待办 日志 小结 流水".split(),
    "META_COMMENT_WORDS": "不知道写 不知道咋写 不知道怎么写 说不出来 说不上 想不起 想不出 没什么可写 没啥可写 不会写 不知道从哪 凑不出 自评不知道该写".split(),
    "RATING_STRONG": "超出预期 超预期 远超目标 卓越 杰出 优秀 超额完成 显著超额 表现突出 业绩突出 成效突出 表现优异 超额达成".split(),
    "RATING_MEET": "达成 达标 符合预期 按期完成 如期完成 按目标完成".split(),
    "RATING_MISS": "未达成 未达标 低于预期 待改进 不尽如人意 进度滞后".split(),
    "EVID_STRONG": "提前 超额 创新高 翻倍 降至 降到 提升至 提升到 回落到 沿用 推广 复用 采纳 归零 获评 获奖 达成率 完成率 清零 无差错 零差错 率先 首创 全部完成 一次性通过".split(),
    "EVID_MISS": "缺口 延期 逾期 不达标 未完成 未实现 滞后 拖后 未启动 差口".split(),
    "META_COMMENT_VERBS": "写 说 想 凑 编 讲 归纳 总结 罗列 回忆 挤".split(),
    "META_COMMENT_TAILS": "不出 不来 不起来 不清楚 咋写 怎么写 什么".split(),
    "PERIOD_WORDS": "统计 区间 累计 全年 本月 本季 本学期 截至 自 口径 同期".split(),
}
PROFILES = {
    "office": {
    },
    "school": {
        "add": {
            "ACTIVITY_VERBS": "监考 阅卷 查寝 排课 调课 家访 带班 听课 评课 教研".split(),
            "RESULT_SIGNALS": "结课 结题 通过验收 获评 评优".split(),
            "RISK_SIGNALS": "休学 退学 留级 校园安全".split(),
            "VAGUE_PRAISE": "教学秩序井然 学风明显好转".split(),
        },
        "add_units": "课时 节课 人次 门".split(),
        "add_cn_units": "节课 门 届".split(),
    },
    "factory": {
        "add": {
            "ACTIVITY_VERBS": "点检 交接班 上料 巡检 试运行 试模".split(),
            "RESULT_SIGNALS": "达产 首件合格 量产 验机".split(),
            "RISK_SIGNALS": "停线 待料 超差 飞件 漏检".split(),
            "NEGATIVE_METRICS": "零伤害 零停机 零超差".split(),
        },
        "add_units": "班次 工单 炉次 台套 吨".split(),
        "add_cn_units": "班次 道工序".split(),
    },
    "retail": {
        "add": {
            "ACTIVITY_VERBS": "陈列 理货 盘货 站柜 试吃 巡店".split(),
            "RESULT_SIGNALS": "售罄率 补货 翻台 开业".split(),
            "RISK_SIGNALS": "临期 缺货 断码 差评".split(),
            "VAGUE_PRAISE": "生意红火 客流不错".split(),
        },
        "add_units": "客单 SKU 箱 提".split(),
        "add_cn_units": "档 笔".split(),
    },
}
