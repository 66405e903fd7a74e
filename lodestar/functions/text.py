"""Text rules as Column functions. Lengths are in bytes where a rule says bytes; keyword tests are substring tests."""

from __future__ import annotations

import re
import sys
from collections.abc import Callable
from functools import cache, partial, reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# The character ranges that count as CJK (without the ideographic space, which is white space).
CJK = r"\u4e00-\u9fff\u3400-\u4dbf\u3001-\u303f\u3040-\u309f\u30a0-\u30ff\uac00-\ud7af"
_WORD = r"\p{IsAlphabetic}\p{N}\-_./:"


def tokenize(text: Column) -> Column:
    """Lower-cased words of letters, digits and - _ . / :, and runs of CJK characters as overlapping pairs (a single
    one as itself; up to three also as a whole). Only texts with a CJK character pay for the pairs."""
    low = F.lower(text)
    runs = F.regexp_extract_all(low, F.lit(f"([{CJK}]+|[{_WORD}&&[^{CJK}]]+)"), F.lit(1))

    def split(run: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))
        whole = F.when(F.length(run) <= 3, F.array(run)).otherwise(F.array().cast("array<string>"))
        cjk = F.when(F.length(run) == 1, F.array(run)).when(F.length(run) == 2, F.array(run, run)).otherwise(F.concat(pairs, whole))
        return F.when(run.rlike(f"^[{CJK}]"), cjk).otherwise(F.array(run))

    plain = F.filter(F.split(low, f"[^{_WORD}]+"), lambda w: w != "")
    return F.when(low.rlike(f"[{CJK}]"), F.flatten(F.transform(runs, split))).otherwise(plain)


@cache
def letters() -> str:
    """The characters of words as Spark's regular expressions know them, as ranges of a class for Python's."""
    every = "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF)
    pattern = SparkSession.active().sparkContext._jvm.java.util.regex.Pattern.compile(r"[^\p{IsAlphabetic}\p{N}]+")
    codes = [ord(c) for c in pattern.matcher(every).replaceAll("")]
    starts = [c for c, before in zip(codes, [-2, *codes], strict=False) if c != before + 1]
    ends = [c for c, after in zip(codes, [*codes[1:], -2], strict=True) if after != c + 1]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends, strict=True))


def runs(ranges: str, extra: str) -> Callable[[str], list[str]]:
    """What finds the runs of characters of a class in a text. Few texts have characters behind U+FFFF, and the ranges there
    are tried one by one, so other texts go by a class without them."""
    low = "".join(x for x in re.findall(r"\\U.{8}-\\U.{8}", ranges) if x < r"\U00010000")
    few, every = re.compile(f"[{low}{extra}]+").findall, re.compile(f"[{ranges}{extra}]+").findall
    return lambda text: (few if text.isascii() or len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text) else every)(text)


def tokenizer(ranges: str) -> Callable[[str], list[str]]:
    """tokenize for lower-cased texts within a Python task; ranges: letters()."""
    plain, cjk = runs(ranges, r"\-_./:"), re.compile(f"[{CJK}]")
    mixed = re.compile(f"[{CJK}]+|(?:(?![{CJK}])[{ranges}\\-_./:])+")

    def tokens(text: str) -> list[str]:
        if text.isascii() or not cjk.search(text):
            return plain(text)
        out = []
        for run in mixed.findall(text):
            if cjk.match(run) and len(run) > 1:
                out += [run[i : i + 2] for i in range(len(run) - 1)] + ([run] if len(run) <= 3 else [])
            else:
                out.append(run)
        return out

    return tokens


def share_contained(words: Column, text: Column) -> Column:
    """Share of the words that the text contains; 0 for no words."""
    hits = F.size(F.filter(words, lambda w: F.contains(text, w)))
    return F.when(F.size(words) > 0, hits / F.size(words)).otherwise(0.0)


def count_contained(text: Column, words: list[str]) -> Column:
    """How many of the words the text contains; a word that is listed twice counts twice."""
    return reduce(lambda a, b: a + b, (F.contains(text, F.lit(w)).cast("int") for w in words))


def any_contained(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def first_rule(text: Column, rules: list[tuple[str, list[str]]], default: str) -> Column:
    """Name of the first rule of which the text contains a word."""
    out = None
    for name, words in rules:
        hit = any_contained(text, words)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def word_set(text: Column) -> Column:
    """Distinct lower-cased words of at least two bytes; a word is letters, digits and -."""
    parts = F.split(F.lower(text), r"[^\p{IsAlphabetic}\p{N}\-]+")
    return F.array_distinct(F.filter(parts, lambda w: F.octet_length(w) >= 2))


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    """Jaccard similarity of two arrays as sets; 0 if one is empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def fnv1a(text: Column) -> Column:
    """64-bit FNV-1a of the UTF-8 bytes as decimal(20,0); decimals, because a long would overflow."""
    big, prime = "decimal(38,0)", 1099511628211
    size = F.lit(str(2**64)).cast(big)
    octets = F.transform(
        F.sequence(F.lit(1), F.octet_length(text)),
        lambda i: F.conv(F.hex(F.substring(F.encode(text, "UTF-8"), i, F.lit(1))), 16, 10).cast("int"),
    )

    def step(state: Column, octet: Column) -> Column:
        low = F.pmod(state, F.lit(256).cast(big)).cast("int")
        mixed = state - low.cast(big) + low.bitwiseXOR(octet).cast(big)
        return F.pmod(mixed.cast("decimal(20,0)") * F.lit(prime).cast("decimal(14,0)"), size).cast(big)

    start = F.lit("14695981039346656037").cast(big)
    return F.when(F.octet_length(text) == 0, start).otherwise(F.aggregate(octets, start, step)).cast("decimal(20,0)")


# Keyword tables of the importance rule.
HIGH_VALUE = (
    "架构 architecture 决策 decision 关键 critical 重要 important 核心 core 设计 design 安全 security 部署 deploy production 生产 "
    "数据库 database 密钥 secret 密钥 key 约束 constraint 不能改 陷阱 坑 pitfall 血的教训 lesson bug 修复 fix"
).split()
LOW_VALUE = ["测试", "test", "tmp", "临时", "scratch", "实验", "experiment", "随便", "hello world", "测试内容", "testing 123"]
HIGH_LABELS = ["decision", "architecture", "security", "critical", "project-context", "deployment", "configuration"]
LOW_LABELS = ["test", "testing", "tmp", "scratch", "junk"]


def _holds(word: str, text: Column) -> Column:
    return F.contains(text, F.lit(word))


def importance(content: Column, labels: Column) -> Column:
    """Importance of a text by keywords, labels and length, from 0.1 to 3."""
    text, size = F.lower(content), F.octet_length(content)
    low = F.transform(labels, lambda x: F.lower(x))
    score = 1.0 + 0.3 * count_contained(text, HIGH_VALUE) - 0.3 * count_contained(text, LOW_VALUE)
    for word in HIGH_LABELS:
        score = score + 0.4 * F.size(F.filter(low, partial(_holds, word)))
    score = score - 0.5 * F.size(F.filter(low, lambda x: x.isin(LOW_LABELS)))
    score = score + F.when(size > 1500, 0.5).when(size > 500, 0.2).when(size < 30, -0.2).otherwise(0.0)
    return F.least(F.greatest(score, F.lit(0.1)), F.lit(3.0))


# Words and phrases of the classes, in the order in which they are tried.
NOISE_WORDS = "ok 好的 好 yes no nope test 测试 嗯 哦 thanks 谢谢 好嘞 行 可以 done 收到 了解".split()
LABEL_CLASSES = [
    ("decision", ["decision"]), ("bugfix", ["bug"]), ("pattern", ["pattern"]), ("session", ["session-summary", "session"]),
    ("finding", ["finding"]), ("experiment", ["experiment"]), ("security", ["security"]), ("identity", ["identity"]),
    ("research", ["research"]),
]
CONTENT_CLASSES = [
    ("decision", ["[decision]", "决策", "chosen:", "chose", "选用", "改用", "选定", "we decided", "we chose"]),
    ("bugfix", ["[bug]", "symptoms:", "root_cause:", "fix:", "修复了", "resolved by", "workaround:", "hotfix:"]),
    ("pattern", ["[pattern]", "convention:", "always use", "never use", "必须", "约定", "规范", "best practice"]),
    ("session", ["[session]", "accomplished:", "会话总结", "session summary"]),
    ("finding", ["[finding]", "发现", "insight:", "turns out", "关键发现"]),
    ("experiment", ["experiment"]),
    ("security", ["security ban:", "security alert:", "cve-", "vulnerability"]),
    ("identity", ["身份", "identity", "i am", "我是", "我的名字"]),
    ("research", ["[research]", "arxiv", "论文", "前沿", "survey"]),
]


def memory_class(content: Column, labels: Column) -> Column:
    """noise, or the first class whose label is there, else the first whose phrase is; else general."""
    trimmed = F.trim(content)
    text = F.lower(trimmed)
    noise = (F.octet_length(trimmed) < 5) | ((F.octet_length(trimmed) < 20) & text.isin(NOISE_WORDS))
    out = F.when(noise, "noise")
    for name, words in LABEL_CLASSES:
        out = out.when(F.arrays_overlap(labels, F.array(*map(F.lit, words))), name)
    for name, words in CONTENT_CLASSES:
        hit = any_contained(text, words)
        out = out.when(hit | (text.startswith("v") & F.contains(text, F.lit("实验"))) if name == "experiment" else hit, name)
    return out.otherwise("general")


# Base scores of the classes, and the words that raise them.
CLASS_BASE = {
    "identity": 3.0, "decision": 2.5, "experiment": 2.0, "finding": 2.0, "bugfix": 1.5, "pattern": 1.5, "research": 1.5,
    "security": 1.2, "session": 1.0, "general": 0.8, "noise": 0.0,
}
CRUCIAL = ["critical", "不能", "never", "绝对不能", "必须", "致命", "crucial", "vital"]
NOTABLE = ["重要", "important", "关键", "key"]
CODE_MARKS = ["```", "fn ", "pub fn", "impl ", "cargo ", "use "]


def intake_importance(content: Column, kind: Column) -> Column:
    """Importance at intake by class, wording, length and code, from 0.1 to 3.5."""
    text, size = F.lower(content), F.octet_length(content)
    base = F.create_map(*(F.lit(x) for pair in CLASS_BASE.items() for x in pair))[kind]
    score = base + F.when(any_contained(text, CRUCIAL), 0.5).when(any_contained(text, NOTABLE), 0.3).otherwise(0.0)
    score = score + F.when(size > 200, 0.2).when(size > 50, 0.1).otherwise(0.0)
    score = score + F.when(any_contained(text, CODE_MARKS), 0.1).otherwise(0.0)
    return F.least(F.greatest(score, F.lit(0.1)), F.lit(3.5))


# Keyword and the tag that it gives.
TAGS = [
    ("rust", "rust"), ("cargo", "rust"), ("tokio", "async"), ("python", "python"), ("typescript", "typescript"),
    ("javascript", "javascript"), ("react", "frontend"), ("tailwind", "frontend"), ("css", "frontend"), ("nginx", "nginx"),
    ("docker", "docker"), ("kubernetes", "k8s"), ("sqlite", "database"), ("postgres", "database"), ("redis", "database"),
    ("ssh", "ssh"), ("https", "https"), ("certbot", "ssl"), ("git", "git"), ("github", "github"), ("ci/cd", "cicd"),
    ("wasm", "wasm"), ("onnx", "ml"), ("embedding", "ml"), ("xss", "security-vuln"), ("csrf", "security-vuln"),
    ("cve", "security-vuln"), ("curl", "debugging"), ("日志", "logging"), ("log::", "logging"), ("deploy", "deployment"),
    ("部署", "deployment"),
]


def tags(content: Column) -> Column:
    """Sorted distinct tags of the keywords that the text contains."""
    text = F.lower(content)
    found = F.array(*(F.when(F.contains(text, F.lit(word)), F.lit(tag)) for word, tag in TAGS))
    return F.array_sort(F.array_distinct(F.array_compact(found)))


# Keyword and the label that it gives, in order.
TOPICS = [
    ("函数", "code"), ("function", "code"), ("class ", "code"), ("import ", "code"), ("fn ", "code"), ("pub ", "code"),
    ("架构", "architecture"), ("设计", "architecture"), ("模块", "architecture"), ("系统", "architecture"),
    ("component", "architecture"), ("安全", "security"), ("加密", "security"), ("认证", "security"), ("密码", "security"),
    ("authentication", "security"), ("测试", "testing"), ("test", "testing"), ("bug", "testing"), ("部署", "deployment"),
    ("服务器", "deployment"), ("docker", "deployment"), ("nginx", "deployment"), ("systemd", "deployment"),
    ("数据库", "database"), ("sql", "database"), ("sqlite", "database"), ("查询", "database"), ("query", "database"),
    ("api", "api"), ("接口", "api"), ("endpoint", "api"), ("性能", "performance"), ("优化", "performance"),
    ("延迟", "performance"), ("文档", "docs"), ("README", "docs"), ("说明", "docs"), ("配置", "config"),
    ("环境变量", "config"), ("config", "config"), ("用户", "user"), ("权限", "user"), ("角色", "user"), ("记忆", "memory"),
    ("搜索", "search"), ("向量", "vector"), ("算法", "algorithm"), ("模型", "model"), ("训练", "ml"),
]


def topics(content: Column) -> Column:
    """The first three distinct labels whose keyword the lower-cased text contains; general if none."""
    text = F.lower(content)
    found = F.array_distinct(F.array_compact(F.array(*(F.when(F.contains(text, F.lit(w)), F.lit(x)) for w, x in TOPICS))))
    return F.when(F.size(found) > 0, F.slice(found, 1, 3)).otherwise(F.array(F.lit("general")))


# Word, and what it adds to pleasure, arousal and dominance.
MOODS = {
    "create": (0.3, 0.2, 0.1), "new": (0.2, 0.3, 0.0), "goal": (0.2, 0.1, 0.2), "success": (0.4, 0.1, 0.2),
    "happy": (0.5, 0.2, 0.1), "love": (0.5, 0.3, 0.1), "good": (0.3, 0.1, 0.1), "great": (0.4, 0.2, 0.1),
    "error": (-0.3, 0.3, -0.1), "fail": (-0.4, 0.2, -0.2), "danger": (-0.2, 0.5, -0.3), "guard": (-0.1, 0.3, 0.2),
    "protect": (0.1, 0.2, 0.3), "dead": (-0.5, 0.3, -0.3), "broken": (-0.3, 0.2, -0.2), "loss": (-0.4, 0.1, -0.2),
    "identity": (0.1, 0.0, 0.3), "memory": (0.1, 0.0, 0.1), "search": (0.1, 0.2, 0.1), "merge": (0.1, 0.0, 0.1),
    "split": (-0.1, 0.3, 0.0), "architecture": (0.0, 0.1, 0.2), "safe": (0.2, -0.1, 0.3), "rust": (0.1, 0.0, 0.2),
    "ai": (0.1, 0.2, 0.1), "修复": (0.2, 0.2, 0.1), "错误": (-0.3, 0.3, -0.1), "部署": (0.1, 0.2, 0.1),
    "dream": (0.1, 0.1, 0.0), "living": (0.3, 0.2, 0.1), "organism": (0.2, 0.2, 0.1), "tetrahedron": (0.0, 0.1, 0.2),
    "pulse": (0.1, 0.4, 0.1), "discover": (0.3, 0.4, 0.2), "fission": (-0.1, 0.3, 0.0), "fuse": (0.1, 0.0, 0.1),
    "honest": (0.2, 0.0, 0.3), "serious": (0.0, 0.1, 0.3), "efficient": (0.2, 0.0, 0.2), "rigorous": (0.1, 0.0, 0.3),
    "beloved": (0.5, 0.2, 0.1), "passionate": (0.4, 0.3, 0.2), "完成": (0.3, 0.1, 0.2), "成功": (0.4, 0.1, 0.2),
    "失败": (-0.4, 0.2, -0.2), "危险": (-0.2, 0.5, -0.3), "安全": (0.2, -0.1, 0.3), "架构": (0.0, 0.1, 0.2),
    "紧急": (-0.1, 0.5, 0.1), "重要": (0.1, 0.3, 0.3), "关键": (0.1, 0.3, 0.3), "陷阱": (-0.2, 0.3, 0.0),
    "踩坑": (-0.2, 0.3, 0.0), "优化": (0.3, 0.1, 0.2), "重构": (0.2, 0.2, 0.1), "崩溃": (-0.4, 0.4, -0.2),
    "解决": (0.3, 0.1, 0.2), "突破": (0.4, 0.3, 0.2), "创建": (0.3, 0.2, 0.1), "发现": (0.3, 0.3, 0.2),
    "警告": (-0.1, 0.3, 0.0), "注意": (0.0, 0.2, 0.1),
}

# Keyword and the label that a query with it favours.
FAVOURED = [
    ("部署", "deployment"), ("deploy", "deployment"), ("发布", "deployment"), ("安全", "security"), ("security", "security"),
    ("前端", "frontend"), ("frontend", "frontend"), ("react", "frontend"), ("后端", "backend"), ("backend", "backend"),
    ("rust", "rust"), ("编译", "build"), ("cargo", "build"), ("build", "build"), ("nginx", "nginx"), ("防火墙", "firewall"),
    ("firewall", "firewall"), ("数据库", "database"), ("sqlite", "database"), ("db", "database"), ("mcp", "mcp"),
    ("guard", "guard"), ("docker", "docker"), ("容器", "docker"), ("https", "https"), ("证书", "ssl"), ("ssl", "ssl"),
    ("certbot", "ssl"), ("测试", "testing"), ("test", "testing"), ("git", "git"), ("github", "github"), ("配置", "config"),
    ("config", "config"),
]

# Term and the words that a query with it is widened by.
WIDENED = {
    "部署": "deploy deployment release publish", "安全": "security vulnerability CVE", "修复": "fix patch resolve hotfix",
    "错误": "error bug crash panic", "性能": "performance optimization latency throughput",
    "架构": "architecture design structure", "数据库": "database sqlite postgres db", "前端": "frontend react UI dashboard",
    "后端": "backend server API", "防火墙": "firewall nft iptables firewalld", "编译": "build compile cargo",
    "测试": "test testing CI", "配置": "config configuration settings", "证书": "certificate SSL TLS certbot",
}

# What a word to leave out stands after; and phrases that open a reason, in the order they are tried.
EXCLUDING = ["不要用", "不要", "不用", "避免", "except ", "without ", "exclude ", "not "]
CAUSAL = ["因为", "由于", "because", "since ", "as ", "原因是", "reason:", "why:", "所以", "therefore", "in order to", "目的是"]


def favoured(query: Column) -> Column:
    """Sorted distinct labels that a query favours."""
    text = F.lower(query)
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(F.contains(text, F.lit(w)), F.lit(x)) for w, x in FAVOURED)))))


def widened(query: Column) -> Column:
    """Sorted distinct words that a query is widened by."""
    text = F.lower(query)
    found = [F.when(F.contains(text, F.lit(w)), F.lit(x.split())).otherwise(F.array().cast("array<string>")) for w, x in WIDENED.items()]
    return F.array_sort(F.array_distinct(F.concat(*found)))


def excluded(query: Column) -> Column:
    """Sorted distinct words to leave out: after the first fitting place of each opening, an ASCII word of two letters or more."""
    text = F.lower(query)
    after = [F.regexp_extract(text, f"{words}([a-z0-9]{{2,}})", 1) for words in EXCLUDING]
    return F.array_sort(F.array_distinct(F.filter(F.array(*after), lambda w: w != "")))


def reason(content: Column, kind: Column) -> Column:
    """Why, for decisions, findings and patterns: after "rationale:" 300 characters, else 250 from the first causal
    phrase of the list that occurs. Null if there is none."""
    text = F.lower(content)
    out = F.when(~kind.isin("decision", "finding", "pattern"), F.lit(None).cast("string"))
    at = F.instr(text, "rationale:")
    out = out.when(at > 0, F.trim(F.substring(content, at + 10, F.lit(300))))
    for words in CAUSAL:
        at = F.instr(text, words)
        out = out.when(at > 0, F.trim(F.substring(content, at, F.lit(250))))
    return out


# Words of denial that mark a correction of an earlier text, at the scan and at intake.
DENIALS = "不是 不能 错误 修正 已修正 fix fixed wrong incorrect 不再 改为 替代 deprecated 废弃 移除 removed".split() + ["instead of"]
INTAKE_DENIALS = DENIALS + ["fixes", "换为", "renamed", "should not"]

# Labels and the category that they give, in the order in which they are tried.
CATEGORIES = [
    ("science.physics", "physics quantum mechanics relativity thermodynamics"), ("science.biology", "biology genetics dna evolution"),
    ("science.astronomy", "astronomy planet solar space"), ("tech.programming", "git programming python rust coding version"),
    ("tech.networking", "network tcp protocol http"), ("tech.cryptocurrency", "crypto bitcoin blockchain"),
    ("life.food", "coffee food cooking nutrition diet"), ("culture.music", "music mozart art composition"),
    ("geo.geography", "geography mountain volcano trench ocean"), ("tech.electronics", "battery energy electronics device"),
    ("nature.animal", "bee animal insect nature"), ("history.general", "history war ancient empire"),
    ("language.general", "language grammar linguistics"),
]

# Labels of the service and cognitive layers.
SERVICE = "engineering optimization programming database storage security architecture".split()
COGNITIVE = "ai ml science biology physics mathematics concept reasoning".split()

# Words of a query, its intent, and the boosts of the memory classes that it gives; later rules overwrite.
RECENT = "昨天 前天 recent latest 最近 上次 上一次 刚才 今天 today".split() + ["last time", "just now"]
THIS_WEEK = ["本周", "这周", "this week"]
INTENTS = [
    ("fix", "怎么修 怎么解决 解决 修复 debug troubleshoot 报错 error crash panic bug 不工作 不生效 失败".split() + ["how to fix"], {"bugfix": 2.5, "pattern": 1.5}),
    ("decision", "为什么 决定 decided why 为什么选 reason 原因 为什么用 rationale 为什么不用".split(), {"decision": 2.5}),
    ("pattern", "规范 约定 convention 怎么写 怎么用 正确方式 standard 惯例".split() + ["how to", "best practice"], {"pattern": 2.5}),
    ("architecture", "架构 设计 architecture design 结构 模块".split(), {"decision": 1.5, "pattern": 1.5}),
    ("security", "安全 漏洞 vulnerability xss csrf 注入 攻击 封禁".split(), {"security": 2.0}),
    ("performance", "性能 优化 performance 慢 slow latency 吞吐 throughput".split(), {"finding": 1.8}),
    ("comparison", "对比 比较 vs versus 区别 不同 difference 还是 哪个好 哪个".split() + ["which is better"], {"decision": 2.0, "finding": 1.5}),
]

# Parts of a request path that mark an attack.
ATTACKS = [
    "union select", "or 1=1", "' or ", "\" or ", "; drop ", "information_schema", "sleep(", "benchmark(", "<script", "javascript:",
    "onerror=", "onload=", "alert(", "document.cookie", "../", "..%2f", "..%5c", "/etc/passwd", "/proc/self", "/etc/shadow", ".env",
    ".git/", ".git/config", "wp-admin", "wp-login", "phpmyadmin", "wp-config", ".ds_store", "backup.sql", ".htaccess", "/debug",
    "/console", "/actuator", "/phpinfo", "/server-status", "/.svn", "/.hg", ";ls", ";cat ", ";id", ";whoami", ";uname", "%0d%0a",
    "$(", "`id`", "eval(", "base64_decode", "file_get_contents", "/bin/sh", "/bin/bash", "/usr/bin/", "cmd.exe", "powershell",
    "config.json", "docker.env", ".env.dev", ".env.backup", ".env.old", ".env.bak", ".env.local", ".env.production",
]


def word_list(text: Column) -> Column:
    """Lower-cased words of at least two bytes, with repeats."""
    return F.filter(F.split(F.lower(text), r"[^\p{IsAlphabetic}\p{N}\-]+"), lambda w: F.octet_length(w) >= 2)


def topic_overlap(own: Column, others: Column) -> Column:
    """Share of the words, repeats included, that the set of others has; 0 for no words. Both should be columns of their
    own (word_list, word_set): an expression would be worked out again for every word."""
    found = F.size(F.filter(own, lambda w: F.array_contains(others, w)))
    return F.when(F.size(own) > 0, found / F.size(own)).otherwise(0.0)


def fuzzy_match(a: Column, b: Column) -> Column:
    """Whether lengths in bytes differ by a third of the first at most, and the words overlap by more than 0.85."""
    near = F.abs(F.octet_length(a) - F.octet_length(b)) <= F.floor(F.octet_length(a) / 3)
    return near & (jaccard(word_set(a), word_set(b)) > 0.85)


def label_category(labels: Column) -> Column:
    """Dotted category by the first rule that has one of the labels."""
    out = None
    for name, words in CATEGORIES:
        hit = F.arrays_overlap(labels, F.array(*map(F.lit, words.split())))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("general")


def label_layer(labels: Column) -> Column:
    """identity, service, cognitive or instinct, in this order of precedence."""
    low = F.transform(labels, lambda x: F.lower(x))
    joined = F.array_join(low, " ")
    held = lambda words: F.arrays_overlap(low, F.array(*map(F.lit, words)))
    return (
        F.when(held(["system"]) | F.contains(joined, F.lit("identity")), "identity")
        .when(held(SERVICE) | F.contains(joined, F.lit("tool")) | F.contains(joined, F.lit("service")), "service")
        .when(held(COGNITIVE), "cognitive")
        .otherwise("instinct")
    )


def query_intent(query: Column) -> tuple[Column, Column, dict[str, Column]]:
    """Boost of recent memories, primary intent, and the boost of each memory class that a query gives."""
    text = F.lower(query)
    week, recent = any_contained(text, THIS_WEEK), any_contained(text, RECENT)
    temporal = F.when(week, 2.0).when(recent, 2.5).otherwise(1.0)
    primary = F.when(week | recent, "temporal")
    boosts: dict[str, Column] = {}
    for name, words, given in INTENTS:
        hit = any_contained(text, words)
        primary = primary.when(hit, name)
        for kind, boost in given.items():
            boosts[kind] = F.when(hit, boost).otherwise(boosts.get(kind, F.lit(1.0)))
    return temporal, primary.otherwise("general"), boosts


def entity_boost(words: Column, labels: Column) -> Column:
    """Share of the words that the entity labels contain."""
    named = F.filter(labels, lambda x: x.startswith("entity:"))
    text = F.array_join(F.transform(named, lambda x: F.lower(F.regexp_replace(x, "^(entity:)+", ""))), " ")
    return F.when(F.size(named) > 0, share_contained(words, text)).otherwise(0.0)


def sanitized_label(label: Column) -> Column:
    """Letters, digits and - _ . stay, anything else becomes -."""
    return F.regexp_replace(label, r"[^\p{IsAlphabetic}\p{N}\-_.]", "-")


def estimated_tokens(text: Column) -> Column:
    """A third of the bytes and a fifth of the ASCII characters, each rounded down."""
    ascii_ = F.length(F.regexp_replace(text, r"[^\x00-\x7F]", ""))
    return (F.floor(F.octet_length(text) / 3) + F.floor(ascii_ / 5)).cast("long")


def time_ago(hours: Column) -> Column:
    return F.when(hours < 1, "just now").when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago"))).otherwise(F.concat(F.floor(hours / 24).cast("string"), F.lit("d ago")))


def cut_bytes(text: Column, most: int) -> Column:
    """The longest beginning of at most so many bytes that ends between characters."""
    sizes = F.sequence(F.lit(most // 4), F.lit(most))
    fits = F.filter(sizes, lambda n: F.octet_length(F.substring(text, F.lit(1), n)) <= most)
    return F.substring(text, F.lit(1), F.array_max(fits))
