"""Fixed values that results depend on. They are data, stated as they are."""

from __future__ import annotations

# Names of the item sources, in the order in which they are read.
SOURCES = ("bangumi-moe", "acg-rip", "dmhy", "nyaa")

# The same, from the most to the least preferred as an item's main record.
SOURCE_PRIORITY = ("nyaa", "bangumi-moe", "dmhy", "acg-rip")

# Title of an item without one.
UNTITLED = "未命名资源"

# White space that trimming and collapsing know, as a character class's inside.
SPACE = r" \t\n\x0B\f\r\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

# Brackets that open and close parts of a title.
BRACKETS = (("[", "]"), ("【", "】"), ("(", ")"), ("（", "）"))

# Picture heights, and how they compare.
RESOLUTIONS = ("2160p", "1080p", "720p", "480p", "4k")
RESOLUTION_SCORE = {"2160p": 4, "4K": 4, "1080p": 3, "720p": 2, "480p": 1}

# Patterns of codecs.
CODECS = ("hevc", "x265", "x264", r"h\.?264", r"h\.?265", "av1", "10-?bit", "8-?bit", "aac", "flac")

# Numerals of seasons.
NUMERALS = {"一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10}

# Patterns of bracket contents that are metadata and no name.
METADATA = (
    r"\d{1,3}(?:v\d)?", r"\d{1,3}-\d{1,3}", r"\d{1,3}~\d{1,3}", "2160p", "1080p", "720p", "480p", "4k",
    "webrip", "web-?dl", "web-?rip", "bluray", "blu-?ray", "hdtv", "hdrip", "hdr", "avc", "hevc", "x26[45]", r"h\.?26[45]", "av1",
    "aac", "flac", "opus", "e-?ac-?3", r"ddp?\d(?:\.\d)?", "dts", "10-?bit", "8-?bit", "dual[-_ ]?audio", "multi[-_ ]?(?:sub)?s?",
    "simp", "trad", "end", "fin", "finale", "final", "batch", r"v\d", "ma10p", "amzn", "nf", "dsnp", "webdl", "webrip", "mkv", "mp4", "ts",
    "ova", "oad", "sp", "bdrip", "bd", "bdbox", "精校合集", "合集", "生肉", "繁日雙語", "簡日雙語", "简日双语", "繁日双语", "繁中", "简中", "繁体", "简体",
    "内嵌", "内封", "简繁(?:内封|内嵌|日内封|日内嵌)?", "[简繁](?:日)?(?:内封|内嵌|外挂)?(?:字幕)?", "日语", "日文", "中日双语", "中英双语", "多國字幕", "多国字幕", "sub[_-]?esp",
)

# Suffixes of names that say nothing about the series, in the order of removal.
NOISE_SUFFIXES = (" tv", " the animation", " the anime", " animation", " anime", " ova", " oad", " special", " specials", " sp")

# Shortest key that is compared loosely, and the least ratio of a contained key's length.
LOOSE_LENGTH = 6
CONTAINED_RATIO = 0.65

# Standing of release groups, by name in lower case (the name with a capital never matches).
GROUP_REPUTATION = {
    "vcb-studio": 100, "mawen1250": 95, "sweetsub": 90, "lolihouseゆい": 88, "lolihouse": 88, "sakurato": 86, "桜都字幕组": 86, "桜都字幕組": 86,
    "nekomoe kissaten": 84, "喵萌奶茶屋": 84, "千夏字幕组": 82, "千夏字幕組": 82, "天月搬運組": 80, "天月搬运组": 80, "天月字幕組": 80, "天月字幕组": 80,
    "subsplease": 75, "erai-raws": 72, "ani": 70, "lilith-raws": 68, "nc-raws": 66, "orion origin": 64, "猎户不鸽压制": 64, "c.c dynamic": 62,
    "星空字幕组": 60, "星空字幕組": 60, "幻樱字幕组": 58, "幻樱字幕組": 58, "幻月字幕组": 56, "幻月字幕組": 56, "离谱Sub": 54, "悠哈璃羽字幕社": 52,
    "极影字幕社": 50, "極影字幕社": 50, "动漫国字幕组": 48, "動漫國字幕組": 48, "枫叶字幕组": 46, "楓葉字幕組": 46, "豌豆字幕组": 44, "豌豆字幕組": 44,
    "白恋字幕组": 42, "白戀字幕組": 42, "jsum": 40, "skymoon-raws": 38, "ohys-raws": 30, "leopard-raws": 28,
}

# Limits of a search and of its cache.
LIMIT_DEFAULT, LIMIT_MOST = 20, 100
CACHE_SECONDS = 900

# How many of the writes to the cache sweep it.
SWEEP_CHANCE = 0.02

# What stands for a time that is not known; limits of a model call.
UNKNOWN_TIME = "未知时间"
MODEL_SECONDS, MODEL_TOKENS = 45, 2048

# Budget of a refine prompt in estimated tokens, and the parts of the estimate.
PROMPT_TOKENS, PROMPT_BASE, CHARS_PER_TOKEN, TOKENS_PER_ITEM = 50_000, 400, 3, 2
REFINE_MEMO = 200

# Limits of an archive.
ARCHIVE_ITEMS, FILE_BYTES, ARCHIVE_BYTES, NAME_CHARS = 200, 20 * 1024 * 1024, 200 * 1024 * 1024, 180
