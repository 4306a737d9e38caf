"""Fixed values. Results depend on them, so they equal the specification's."""

# Visibility bits.
PUBLIC, DM_ONLY, SECRET, HIDDEN = 1, 2, 4, 8

# Entity types in order of precedence, with the words that suggest them.
ENTITY_WORDS = (
    ("npc", ("NPC", "人物", "角色")),
    ("location", ("地点", "城镇", "酒馆", "港口", "城市", "村庄")),
    ("item", ("物品", "魔法物品", "道具", "武器")),
    ("faction", ("势力", "组织", "公会", "教会")),
    ("rule", ("规则", "裁定")),
    ("plot", ("密谋", "线索", "剧情")),
)
ENTITY_TYPES = tuple(k for k, _ in ENTITY_WORDS)

# Stop words.
STOP_WORDS = (
    "的 了 在 是 我 我们 他 她 他们 有 和 就 都 也 还 这 那 个 一下 一下下 之前 刚才 然后 但是 如果 因为 所以 去 到 把 被 "
    "让 给 要 想 说 问 看 那个 这个 什么 怎么 吗 呢 啊 吧"
).split()

# Markers, placeholders and default titles.
SECRET_PREFIXES = ("【秘密】", "【DM】", "【密谋】")
SECRET_PHRASE = "对玩家隐藏"
HIDDEN_BODY = "（该条目对玩家隐藏）"
UNTITLED, DOCUMENT, PREFACE, UNNAMED_BLOCK, PARAGRAPH = "未命名", "文档", "本章前言", "未命名块", "段落"

# How other names stand in a text and in a title. Which names are found depends on these very markers and brackets.
NAME_MARKERS = ("又名", "别名", "亦称")
NAME_COLONS, NAME_COMMAS, OPEN_BRACKETS, CLOSE_BRACKETS, BRACKET_MOST = ":：", "、,/，;；", "（(", "）)", 20

# Copy templates.
TEMPLATES = {
    "player": "{entity_type}　{title}\n{public_body}\n—— {source_path}",
    "full": "{title}\n{body}\n来源：{source_path}",
    "source": "{source_path}",
}

# What the encoder puts before a query.
QUERY_PREFIX = "为这个句子生成表示以用于检索相关文章："
POOLING = "cls"
DIMENSION = 512

# Retrieval.
RRF_K = 60.0
WEIGHTS = {"fts": 1.0, "index": 2.4, "body": 0.35, "semantic": 1.0}
FTS_LIMIT, PINYIN_LIMIT, LIKE_LIMIT, VECTOR_LIMIT, TERM_FALLBACK_LIMIT = 50, 30, 40, 50, 20
FUSED, RETURNED, FEW = 40, 20, 3
BM25_K1, BM25_B, LEAST_IDF = 1.2, 0.75, 1e-6
QUERY_CHARS, TERM_CAP, GRAM_CAP, RELAXED_GRAM_CAP, PINYIN_COMBOS = 2000, 48, 32, 48, 16
RETENTION = 500
RESERVED = ("AND", "OR", "NOT", "NEAR", "MATCH")

# Cutting texts.
PLAIN_HANZI, PLAIN_CHARS, PLAIN_MOST, TITLE_CHARS = 80, 200, 2000, 40
LONG_BLOCK, LONG_OVERLAP = 900, 40
WINDOW, WINDOW_OVERLAP = 400, 50
SEGMENT, PIECE, PIECE_OVERLAP, PREFIX_COST = 500, 3200, 1, 8
LLM_LEAST, LLM_PLAIN_LEAST = 800, 2200
LOCAL_BODY, LOCAL_UNTITLED, LOCAL_PERCENT, LOCAL_ENTRIES = 12, 40, 50, 2
DUPLICATE_BYTES, ANCHOR_BYTES, PREFACE_LEAST, BODY_LEAST = 24, 200, 40, 8
DICE, LEAD_IN, TINY = 0.7, 80, 24

# The instruction that a model gets; the reply is parsed by sources.llm_json.
SPLIT_ROLES = "npc|location|item|faction|rule|plot"

SCHEMA_VERSION = 3
SOURCE_RANK = 100
