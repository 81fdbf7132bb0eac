"""Fixed values of the dialogue model. They are data, given in natural order; callers may pass their own."""

from __future__ import annotations

# ---- fixed values: sections, categories, showcase datasets -------------------------------------------------------------
TEXT_DIALOGUE = "文本对话"
ANCIENT = "古代汉语"
ANCIENT_CATEGORIES = ("论辩语录", "短篇叙事对白", "历史汉语会话教材", "古典章回小说对白")
MODERN_CATEGORIES = ("戏剧对白", "现当代小说对白")
SECTION_ORDER = ("日常对话", "影视对白", ANCIENT, TEXT_DIALOGUE, "网络回帖", "访谈语料", "课堂互动", "多模态语料")
SHOWCASE = ("雷雨", "平凡的世界", "骆驼祥子")

# ---- fixed values: words and characters that carry no echo -----------------------------------------------------------
STOPWORDS = frozenset(
    "我们 你们 他们 她们 它们 这个 那个 这些 那些 这里 那里 什么 怎么 为什么 是不是 有没有 一个 一种 一些 一下 一样 就是 还是 还是说 然后 所以 但是 不过 因为 如果 可以 "
    "应该 可能 没有 不是 已经 现在 这样 那样 自己 大家 进行 表示 认为 觉得 问题 情况 方面 时候 或者 以及 and the that this with from have will would could should".split()
)
STOP_CHARS = frozenset("的一是在有和与及或就都也很不没吗呢啊吧呀嘛么着过了我你他她它这那")
PHRASE_EDGE = " \t\r\n，。！？、；：,.!?;:\"'（）()【】[]《》<>"

#: Runs of characters that are words of their own.
CHUNK = "[A-Za-z0-9_]{2,}|[一-鿿]{2,6}"

# ---- fixed values: speaker labels -------------------------------------------------------------------------------------
ROLE_TERMS = tuple("记者 主持人 发言人 嘉宾 网友 提问 问 答 老师 学生 旁白 解说 主持 部长 副部长 司长 局长 主任 院士 教授 专家 负责人 代表 委员 先生 女士".split())
EXACT_LABELS = tuple("甲 乙 丙 丁 A B Q 男 女 问 答 用户 助手 系统 中国网".split())
NON_SPEAKER_TERMS = tuple("一是 二是 三是 四是 五是 首先 其次 另外 同时 其中 针对 关于 从 据 据了解 值得一提 总体来看 具体来看 主要集中 积极支持 热切期盼 相关链接 相关附件 责任编辑 版权所有 来源".split())
LABEL_PUNCTUATION = "，,。；;！？!?、"
PLACEHOLDER_LABELS = ("", "—", "-", "－", "未知", "无", "none", "None", "NULL", "null")

# ---- fixed values: frames and markers ---------------------------------------------------------------------------------
FRAMES = (
    ("我觉得...", "我觉得|我认为|我想|我感觉"),
    ("不是...而是...", "不是|而是|并非"),
    ("能不能...", "能不能|可不可以|可以不可以|能否|是否可以"),
    ("为什么...", "为什么|为何|怎么会|怎么"),
    ("如果...就...", "如果|要是|假如|只要|就"),
    ("一边...一边...", "一边|同时|一方面|另一方面"),
)
QUESTION_MARKERS = tuple("? ？ 吗 呢 么 为什么 为何 怎么 能不能 可不可以 是不是 有没有 是否 谁 什么 哪 哪里 多少 几".split())
RESPONSE_MARKERS = tuple("是 不是 对 没有 因为 所以 其实 我觉得 我认为 可以 不能 应该 需要 这个 那".split())
CONTRAST_MARKERS = tuple("不是 不能 没有 没法 不一定 不属于 并不 不对 但是 不过 然而 可是 而是 并非 相反 却".split())
REVISION_MARKERS = tuple("不是 不对 应该说 也就是说 换句话说 准确地说 其实 我是说 或者说 更准确 补充 另外 而且".split())

# ---- fixed values: presets ---------------------------------------------------------------------------------------------
FLAGS = {"lexical_echo": "has_lexical_echo", "pattern_reuse": "has_pattern_reuse", "qa_response": "has_question_response", "contrast_response": "has_negation_turn", "repair_revision": "has_repair_repetition"}
ALIASES = {"lexical_echo": "reproduction", "pattern_reuse": "parallel", "qa_response": "resonance", "question_response": "resonance", "contrast_response": "contrast", "negation_turn": "contrast", "repair_revision": "selection", "repair_repetition": "selection"}
PRESET_FLAGS = {
    "resonance": ("has_lexical_echo", "has_pattern_reuse", "has_question_response", "has_repair_repetition"),
    "reproduction": ("has_lexical_echo",),
    "parallel": ("has_pattern_reuse",),
    "selection": ("has_repair_repetition",),
    "contrast": ("has_negation_turn",),
    "analogy": (),
}

# ---- fixed values: what pages say about a pair of each kind -----------------------------------------------------------
SHARES, REUSES, RECURS = "相邻话轮共享关键词：", "相邻话轮复用句式框架：", "相邻话轮出现多处形式复现："
ANSWERS, CONTRASTS, REPAIRS = "前一话轮具有提问特征，后一话轮形成回应。", "后一话轮使用否定或转折标记：", "后一话轮复现前一话轮成分，并出现修正/补充标记。"
ADJACENT = "问答相邻"

# ---- fixed values: relations of a grid and what pages say about them ---------------------------------------------------
RELATION_NOTES = {
    "人称映射": "对话角色在相邻话轮之间发生我/你类转换。",
    "共指候选": "第三人称成分在不同话轮中持续出现，可作为共指候选。",
    "疑问词": "该纵栏集中呈现疑问词或疑问语气标记。",
    "否定": "该纵栏呈现否定性标记，可与相邻谓词形成否定回应。",
    "转折/修正": "该纵栏呈现转折或修正标记。",
    "句式复现": "该纵栏体现固定句式框架的重复或呼应。",
    "词汇重现": "相同或高度接近的词汇在多个话轮中重复出现。",
    "否定回应": "后一话轮使用否定标记并与相邻词项组合，形成否定性回应或修正。",
    "疑问回应": "前一话轮含疑问词或疑问标记，后一话轮构成相邻回应。",
}

# ---- fixed values: files that may be uploaded and transcribed ----------------------------------------------------------
VIDEO_FILES = ("mp4", "mov", "webm", "mkv")
AUDIO_FILES = ("mp3", "wav", "m4a", "aac", "ogg", "flac")

# ---- fixed values: full-width marks that users type in patterns --------------------------------------------------------
FULL_WIDTH = {"（": "(", "）": ")", "｜": "|", "［": "[", "］": "]", "｛": "{", "｝": "}", "，": ",", "．": ".", "＊": "*", "＋": "+", "？": "?", "＾": "^", "＄": "$", "＼": "\\"}
