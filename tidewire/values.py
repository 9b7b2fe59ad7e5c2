"""Fixed values of the domain: windows, thresholds, word lists and patterns."""

from __future__ import annotations

# Query parameters that only track a reader.
TRACKING_PARAMS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id",
    "gclid", "gclsrc", "dclid", "fbclid", "msclkid", "twclid", "igshid",
    "mc_cid", "mc_eid", "oly_anon_id", "oly_enc_id",
    "spm", "scm", "from", "ref", "ref_src", "refer", "referer", "scene", "chksm",
    "wxshare", "share_token", "share_from", "shareurl", "key", "ascasing", "ts",
    "via", "sharer", "clicktime", "enterad",
]

# Tags that say nothing about a story.
GENERIC_TAGS = [
    "ai", "a.i.", "人工智能", "ai技术", "ai模型", "ai应用", "ai产业", "ai公司",
    "大模型", "大语言模型", "llm", "llms", "agi", "生成式ai", "genai",
    "机器学习", "machine learning", "深度学习", "deep learning", "神经网络",
    "artificial intelligence", "ai model", "ai industry",
]

# Who and what makes a suspected incident.
INCIDENT_ORGS = ["microsoft", "azure", "amazon", "aws", "google", "alphabet", "gcp", "meta", "nvidia", "openai", "anthropic", "faa"]
INCIDENT_TRIGGERS = [
    "宕机", "中断", "停飞", "故障", "瘫痪", "崩溃", "不可用", "服务异常", "事故",
    "安全漏洞", "数据泄露", "遭入侵", "勒索", "服务中断", "断网", "网崩",
    "outage", "disruption", "grounding", "grounded", "downtime", "degradation", "degraded",
    "service disruption", "system failure", "infrastructure failure", "meltdown", "crash",
    "unavailable", "breach", "security breach", "cyberattack", "cyber-attack", "ransomware",
    "vulnerability", "data leak", "data breach", "recall",
    "IPO", "首次公开募股", "上市", "挂牌", "敲钟", "募资", "估值", "市值", "并购", "要约收购", "超额认购",
    "listing", "initial public offering", "valuation", "merger", "acquisition", "tender offer",
]
INCIDENT_SOURCES = ["BleepingComputer", "The Register", "Reuters Technology", "Azure Status"]

# Failures of a model service, as parts of a reason.
SERVICE_FAILURES = ["Arrearage", "Access denied", "InvalidApiKey", "Throttling", "API错误", "api error", "timeout", "超时", "429", "500", "502", "503"]

# Reasons that are about quality, hosts that often refuse.
QUALITY_REASON = r"(?i)ungrounded_summary|摘要.*对不上|正文仅.*空壳"
REFUSING_HOSTS = ["politico.com", "thehill.com", "aiera.com"]

# What a probe of a model service says when its account is unusable.
FATAL_STATUS = [401, 402, 403]
FATAL_ANSWER = r"(?i)Arrearage|overdue|欠费|InvalidApiKey|AccessDenied|Access denied|Incorrect API key|Unauthorized"

# Notes behind the marks of a source's health.
HEALTH_NOTES = {
    "PARSED_ZERO": "（页面结构或选择器疑似变更）",
    "ZERO_NO_META": "（爬虫未上报 http/matched）",
    "FILTERED_ALL": "（出时效窗或全被去重）",
}

# What a page without an article says.
SHELL_STRONG = [
    "正在取这篇稿子", "页面走丢了", "页面不存在", "页面未找到", "打开微信阅读", "请在微信客户端打开", "点击屏幕右上方",
    "登录后可见", "登录后查看", "登录阅读全文", "原文已被删除", "内容已被删除", "该文章已撤回",
    "请开启JavaScript", "请启用JavaScript", "需要启用JavaScript", "请启用 JS",
]
SHELL_WEAK = ["环境异常", "安全验证", "访问过于频繁", "加载失败", "出错了"]
SHELL_LINE = 40
# What a short line of navigation holds, its greatest length, and the least text that can be summarised.
NAVIGATION = r"(关注|点赞|在看|分享|扫码|订阅|举报|广告|版权|免责|上一篇|下一篇|返回首页|目录|标签|来源|编辑|记者|审核|责任编辑|扫码关注|阅读原文|点击阅读)"
NAVIGATION_LINE = 24
LEAST_MATERIAL, TRUSTED_SNIPPET = 200, 300
SHELL_PATTERNS = [r"(?i)404\s*(not\s*found|页面|错误)", r"(?i)(?<![A-Za-z0-9_])not\s*found(?![A-Za-z0-9_])", r"HTTP\s*/?\s*1\.[01]\s+404"]

# Round-up columns, clickbait, domestic media hosts.
ROUNDUP_COLUMN = r"(?i)(早知道|早报|晚报|午报|日报|周报|月报|速览|一览|盘点|要闻|合集|合辑|晨讯|roundup|digest|briefing|bulletin)"
CLICKBAIT = r"(封杀|全面禁止|全面禁用|首次|碾压|史上最强|突发|重磅|紧急)"
DOMESTIC_HOSTS = r"(?i)jiqizhixin\.com|qbitai\.com|leiphone\.com|zhidx\.com|aiera\.com\.cn|geekpark\.net|infoq\.cn"

# Charset labels.
CHARSET_ALIASES = {
    "utf8": "utf-8", "utf-8": "utf-8",
    "shift_jis": "shift_jis", "shift-jis": "shift_jis", "sjis": "shift_jis",
    "cp932": "shift_jis", "ms932": "shift_jis", "windows-31j": "shift_jis", "x-sjis": "shift_jis",
    "euc-jp": "euc-jp", "eucjp": "euc-jp", "x-euc-jp": "euc-jp", "euc": "euc-jp",
    "iso-2022-jp": "iso-2022-jp", "jis": "iso-2022-jp", "iso2022jp": "iso-2022-jp",
    "gbk": "gbk", "gb2312": "gbk", "gb-2312": "gbk", "euc-cn": "gbk",
    "gb18030": "gb18030", "cp936": "gbk", "windows-936": "gbk", "ms936": "gbk",
    "big5": "big5", "big5-hkscs": "big5", "cp950": "big5",
    "euc-kr": "euc-kr", "euckr": "euc-kr", "ksc5601": "euc-kr", "cp949": "euc-kr", "windows-949": "euc-kr",
    "utf-16": "utf-16", "utf-16le": "utf-16le", "utf-16be": "utf-16be",
}

# Bands, tiers (lowest, highest, seats), categories.
BANDS = [(90, "重磅"), (80, "重要"), (70, "值得看"), (60, "可看")]
LOWEST_BAND = "边缘"
TIERS = [(90, 94, 1), (80, 89, 3), (70, 79, None), (60, 69, None), (40, 59, None)]
CATEGORIES = ["company", "technology", "opensource", "funding", "opinion", "policy", "infra", "noise"]
SENTINEL = "unknown"

# Subjects of titles and how they are written (case-insensitive patterns; \b is an ASCII word border).
SUBJECTS = {
    "OpenAI": ["openai", "chatgpt", r"gpt-?\d", "sora", r"o\d-mini"],
    "Anthropic": ["anthropic", "claude"],
    "Google": ["google", "deepmind", "gemini", "gemma", "imagen", "tpu"],
    "Meta": [r"\bmeta\b", "facebook", "llama", "whatsapp"],
    "Microsoft": ["microsoft", "azure", "copilot"],
    "Amazon": ["amazon", r"\baws\b", "alexa"],
    "Apple": [r"\bapple\b", "siri"],
    "NVIDIA": ["nvidia", "jensen huang", "黄仁勋"],
    "Mistral": ["mistral", "le chonk"],
    "DeepSeek": ["deepseek", "深度求索"],
    "xAI": [r"\bxai\b", "grok", "musk"],
    "阿里": ["阿里", "alibaba", "通义", "qwen", "夸达"],
    "腾讯": ["腾讯", "混元", "hunyuan"],
    "字节": ["字节", "bytedance", "豆包", "doubao", "tiktok"],
    "百度": ["百度", "文心", "ernie"],
    "华为": ["华为", "huawei", "盘古", "pangu"],
    "智谱": ["智谱", "zhipu", r"\bglm\b"],
    "月之暗面": ["月之暗面", "moonshot", "kimi"],
    "MiniMax": ["minimax", "海螺"],
    "科大讯飞": ["讯飞", "spark", "iflytek"],
    "商汤": ["商汤", "sensetime"],
    "百川": ["百川", "baichuan"],
    "阶跃星辰": ["阶跃", "stepfun"],
    "HuggingFace": [r"hugging\s?face"],
    "Midjourney": ["midjourney"],
    "Sony": [r"\bsony\b"],
    "Samsung": ["samsung", "三星"],
    "Intel": [r"\bintel\b"],
    "AMD": [r"\bamd\b"],
    "台积电": ["台积电", "tsmc"],
    "软银": ["软银", "softbank"],
    "Ssi": [r"\bssi\b", "扎伯格", "zuckerberg", "biohub"],
    "特斯拉": ["特斯拉", "tesla", "optimus"],
    "Figure": [r"figure\s?ai"],
    "Runway": ["runway"],
    "ElevenLabs": ["elevenlabs", "eleven labs"],
}
