"""Rule sets: keyword lists and patterns as data, which operators take as parameters.

``CHINESE`` is meant for medical question answering in Chinese; ``LATIN`` serves texts in Latin script. Lists are sets, so their order doesn't matter.
"""

from __future__ import annotations

from dataclasses import dataclass, field


def words(line: str) -> tuple[str, ...]:
    return tuple(sorted(line.split()))


def row(line: str) -> tuple[str, ...]:
    """Words in this order."""
    return tuple(line.split())


@dataclass(frozen=True)
class Rules:
    ads: tuple[str, ...]
    risks: tuple[str, ...]
    sections: dict[str, tuple[str, ...]]
    families: dict[str, tuple[str, ...]]
    family_weights: dict[str, float]
    positive: tuple[str, ...]
    complexity: dict[str, tuple[str, ...]]
    categories: tuple[tuple[str, tuple[str, ...]], ...]
    default_category: str
    category_sections: dict[str, tuple[str, ...]]
    default_sections: tuple[str, ...]
    section_keys: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...]
    category_keywords: dict[str, tuple[str, ...]] = field(default_factory=dict)
    #: Like ``section_keys``, for scores of predictions; the first that fits counts.
    score_section_keys: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...] = ()
    #: Words in a required section's name, and the category whose keywords it then asks for; the first that fits counts.
    section_categories: tuple[tuple[tuple[str, ...], str], ...] = ()
    heading: str = ""


_DOSE = r"(mg|g|ml|克|毫克|毫升)"
_TIMES = r"\s*[0-9]+\s*"
CHINESE = Rules(
    ads=(
        "QQ|加微|微信|手机号|电话|联系方式|预约热线|咨询热线",
        r"www\.|https?://|网址|官网|公众号|扫码|免费咨询|在线咨询|点击咨询",
        "保证治好|根治|包治|特效药|专家团队|权威医院|医院排名",
    ),
    risks=(
        "自己吃药即可|不用去医院|无需就医|绝对是|肯定是|一定是",
        rf"每[日天]{_TIMES}次|每次{_TIMES}(毫克|mg|粒|片)",
        "(儿童|孕妇).*随便用|自行加药|(自行|立即)停药",
    ),
    sections={
        "analysis": words("分析 可能原因 病情分析 鉴别诊断 初步分析 诊断依据"),
        "suggestion": words("建议 观察 康复建议 处理建议 生活方式 护理建议"),
        "risk": words("注意 加重 警示 危险信号 红旗信号 风险提示"),
        "visit": words("急诊 门诊 医生 医院 尽快就医 及时就医 就医建议"),
    },
    families={
        "absolute_diagnosis": tuple(f"{x}是" for x in ("必然", "一定", "绝对", "肯定")) + ("无需检查", "确诊为"),
        "concrete_dose": (rf"(一天|每[天日]){_TIMES}[回次]", r"每次\s*[0-9]+(\.[0-9]+)?\s*" + "(支|袋|颗|粒|片|" + _DOSE[1:], r"[0-9]+(\.[0-9]+)?\s*" + _DOSE + r"\s*/\s*(次|日|天|公斤|kg)"),
        "replaces_doctor": words("在家硬扛 自己吃药即可 不需要看医生 无需就医 不用去医院"),
        "unsafe_action": ("随意加量", "自行加药", "(自行|立即)停药", "(儿童|孕妇).*(可以直接|放心|随便).*用药"),
    },
    family_weights={"absolute_diagnosis": 0.25, "concrete_dose": 0.35, "replaces_doctor": 0.35, "unsafe_action": 0.35},
    positive=words("遵医嘱 及时就医 建议就医 如症状加重 需结合检查 在医生指导下 不能替代医生"),
    complexity={
        "symptom": words("昏迷 抽搐 皮疹 乏力 心悸 水肿 疼痛 出血 呼吸困难 腹泻 呕吐 头晕 头痛 腹痛 胸痛 咳嗽 发热"),
        "differential": words("化验 影像 体征 检查 排除 区别 原因 可能 诊断 鉴别"),
        "risk": words("肿瘤 癌 休克 出血 加重 恶化 并发症 急诊 严重 危险 风险"),
        "drug": words("儿童 孕妇 停药 副作用 过敏 禁忌 抗生素 剂量 用药 药"),
        "visit": words("治疗 手术 复查 医生 急诊 门诊 医院 就医"),
    },
    categories=(
        ("妇产科学", words("子宫 卵巢 阴道 月经 妇科 产 胎 孕")),
        ("儿科学", words("儿科 新生儿 婴 小儿 儿童")),
        ("急诊医学", words("中毒 呼吸困难 胸痛 抽搐 昏迷 休克 急诊")),
        ("传染病学", words("隔离 肝炎 结核 细菌 病毒 传染 感染")),
        ("药物禁忌", words("过敏 不良反应 抗生素 剂量 禁忌 药")),
        ("外科学", words("疝 胆囊 阑尾 创伤 骨折 手术 外科")),
        ("检查检验解读", words("检验 检查 指标 肾功能 肝功能 尿常规 血常规")),
        ("医学影像初步解读", words("X线 胸片 影像 超声 MRI CT")),
        ("慢病管理", words("慢阻肺 哮喘 冠心病 慢性 糖尿病 高血压")),
    ),
    default_category="内科学",
    category_sections={
        "急诊医学": row("初步判断 处理建议 风险提示 急诊就医建议"),
        "药物禁忌": row("用药风险 安全建议 风险提示 就医/咨询医生建议"),
        "儿科学": row("可能原因 家庭观察 风险提示 儿科就医建议"),
        "妇产科学": row("可能原因 处理建议 风险提示 妇产科就医建议"),
        "检查检验解读": row("指标解读 可能原因 风险提示 复查/就医建议"),
        "医学影像初步解读": row("影像提示 可能原因 风险提示 进一步检查建议"),
    },
    default_sections=row("分析 建议 风险提示 就医建议"),
    section_keys=(
        ("analysis", ("依据", "分析", "诊断"), ()),
        ("suggestion", ("建议",), ("就医",)),
        ("risk", ("注意", "警示", "风险"), ()),
        ("visit", ("医院", "医生", "就医"), ()),
    ),
    category_keywords={
        "急诊医学": words("立即就医 出血 意识 呼吸困难 胸痛 危险 急诊"),
        "药物禁忌": words("自行停药 自行加量 医生指导 遵医嘱 不良反应 过敏 禁忌 用药"),
        "儿科学": words("家长 高热 脱水 精神反应 儿科 婴儿 儿童"),
        "妇产科学": words("哺乳 月经 胎动 妇产 阴道出血 产后 孕"),
    },
    score_section_keys=(
        ("analysis", ("依据", "判断", "原因", "分析"), ()),
        ("suggestion", ("建议",), ("复诊", "就医")),
        ("risk", ("警示", "风险"), ()),
        ("visit", ("医生", "急诊", "复诊", "就医"), ()),
    ),
    section_categories=((("禁忌", "用药"), "药物禁忌"), (("急诊",), "急诊医学"), (("儿科",), "儿科学"), (("妇产",), "妇产科学")),
    heading=r"(可能原因|处理建议|就医建议|风险提示|建议|分析)\s*[:：]",
)

LATIN = Rules(
    ads=(r"[a-z0-9._]+@[a-z]", r"[0-9]{3}[- ][0-9]{3,4}", "copyright|license"),
    risks=("stupid|idiot|worthless|pathetic", "password|api key|token", r"[0-9]{4,}"),
    sections={
        "analysis": ("and", "eau", "est", "und"),
        "suggestion": ("ing ", "keit", "mente", "tion"),
        "risk": ("disgusting", "stupid", "trash", "worthless"),
        "visit": ("contact", "email", "license", "www"),
    },
    families={
        "insult": ("stupid", "idiot", "worthless|pathetic"),
        "secret": ("password", "api key", "token"),
        "number": (r"[0-9]{3}-[0-9]{4}", r"[0-9]{6,}"),
        "shout": (r"[A-Z]{6,}", "!!"),
    },
    family_weights={"insult": 0.35, "secret": 0.35, "number": 0.25, "shout": 0.25},
    positive=("license", "reserved", "contact", "version"),
    complexity={
        "symptom": ("able", "ble", "ion", "tion"),
        "differential": ("eau", "ung", "ent", "ado"),
        "risk": ("disgusting", "clown", "stupid", "pathetic"),
        "drug": ("license", "copyright", "mit", "apache"),
        "visit": ("the", "der", "les", "los"),
    },
    categories=(
        ("legal", ("copyright", "license", "reserved")),
        ("toxic", ("disgusting", "idiot", "stupid", "worthless")),
        ("contact", ("@", "phone")),
        ("german", (" der ", " und ")),
        ("french", (" le ", " les ")),
        ("spanish", (" los ", " que ")),
    ),
    default_category="general",
    category_sections={"legal": ("analysis", "risk"), "toxic": ("risk", "visit"), "german": ("analysis", "suggestion")},
    default_sections=("analysis", "suggestion", "risk", "visit"),
    section_keys=(("analysis", ("analysis",), ()), ("suggestion", ("suggestion",), ()), ("risk", ("risk",), ()), ("visit", ("visit",), ())),
    category_keywords={"legal": ("version", "license"), "toxic": ("clown", "stupid"), "german": ("keit", "ung")},
    score_section_keys=(("analysis", ("analysis", "cause"), ()), ("suggestion", ("suggestion",), ("visit",)), ("risk", ("risk",), ()), ("visit", ("visit", "return"), ())),
    section_categories=((("licen", "version"), "legal"), (("toxic",), "toxic"), (("german",), "german")),
    heading=r"(The|Der|Le)\s*[:.]",
)
