"""Rule tables of the library, all plain data.

Every table here is a default: the operators take them as parameters. Patterns
are written once and compiled to Spark expressions by the functions that use
them; `check_pattern` guards user-supplied ones.
"""

from __future__ import annotations

import re

# --- Fixed values: the 20 categories with their guide texts, in rank order.
TAXONOMY: dict[str, str] = {
    "research": "Academic papers, scientific studies, deep theoretical analysis, and experimental methodologies.",
    "agents": "Autonomous AI systems, multi-agent frameworks, LLM orchestrators, memory systems, and tool use.",
    "workflows": "Business processes, automation sequences, pipeline architectures, CI/CD, and productivity frameworks.",
    "ML": "Machine learning models, neural networks, computer vision, NLP, fine-tuning, training, and benchmarks.",
    "big_data": "Distributed data processing, Spark, Kafka, data lakes, warehouses, ETL architectures, and analytics.",
    "trading": "Financial algorithms, quantitative analysis, market strategies, crypto, economics, and portfolio management.",
    "jobs": "Job postings, recruitment opportunities, career postings, hiring manager contacts, and vacancy specs.",
    "ideas": "Inventions, product concepts, brainstorming notes, raw startup ideas, and visionary musings.",
    "resources": "Curated lists, cheatsheets, dataset links, public APIs, collections, and educational guides.",
    "drafts": "Incomplete writings, work-in-progress blogs, rough notes, and exploratory sketches.",
    "repositories": "Open source GitHub/GitLab repositories, code libraries, source code implementations, and project releases.",
    "tools": "Developer utilities, software applications, SaaS products, CLI tools, libraries, and desktop apps.",
    "rules": "Coding standards, linting rules, architectural constraints, security guidelines, and protocol specs.",
    "policy": "Legal terms, governance guidelines, AI safety policies, regulatory compliance, and privacy rules.",
    "cases": "Real-world case studies, industry post-mortems, practical incident reviews, and business retrospectives.",
    "issues": "Technical bugs, troubleshooting logs, known CVEs, software defects, workarounds, and GitHub issues.",
    "literature": "Books, essays, long-form journalism, philosophical pieces, and historical reviews.",
    "hooks": "Event triggers, webhooks, integration callbacks, prompt hooks, and signal interception mechanisms.",
    "hints": "Quick tips, shortcuts, performance hacks, hidden features, and micro-optimizations.",
    "other": "Miscellaneous links, failed scrapes, unclassifiable content, login walls, and fallback materials.",
}

# --- Fixed values: key themes per category in the compendium, and its two defaults.
DOMAIN_THEMES: dict[str, str] = {
    "agents": "Autonomous AI Agents, LangGraph, Multi-Agent Architectures, Agentic Memory",
    "ML": "Large Language Models, Local Inference, Quantization, RAG Systems, Embeddings",
    "workflows": "Quality Engineering, SDET AI Pipelines, Test Automation, CI/CD, Git Practices",
    "cases": "Real-world Enterprise AI Implementations (Netflix, Silpo, Svoi.ru)",
    "research": "Scientific Benchmarks, Environmental & Market Studies, Frontier Models",
    "tools": "Developer Tooling, VS Code Extensions, Data Protocols (TOON), Utilities",
    "trading": "Financial Markets, Smart Money Concepts, Order Blocks, Prop Trading",
    "hints": "Technical Cheat Sheets, SQL & PostgreSQL Optimization, QA Interview Guides",
    "literature": "Comprehensive Tutorials, Python Best Practices, Programming Guides",
    "repositories": "Curated Open-Source Repositories and Reference Codebases",
    "issues": "Security Research, Penetration Testing, Bug Bounty Insights",
    "jobs": "Market Opportunities, AI & QA Engineering Requirements, Salary Benchmarks",
    "ideas": "Product Concepts, Startup Architectures, AI Applications",
    "other": "General Knowledge & Miscellaneous Articles",
}
TABLE_THEME_DEFAULT = "Technical Knowledge & Resources"
CHAPTER_THEME_DEFAULT = "Technical domain analysis and synthesized notes."

# --- Fixed values: classification patterns per category; list order breaks ties.
CATEGORY_PATTERNS: dict[str, list[str]] = {
    "jobs": [
        r"\b(?:engineer\s*[\$€£0-9]|qa\s+engineer|sdet|manual\s+qa|middle\s+qa|senior\s+qa|qa\s+tester|full\s*stack\s+qa|automation\s+qa|qa\s+manual|careers|job\s+openings|ваканс|найди\s+работу|віддалена\s+робота|online\s+class\s+linkedin|softeq\s+careers|grid\s+dynamics|zoolatech|omnicore|blackrock\s+software|ascendix|startupsoft|neverending|dash\s+financial|quantox|mind\s+studios|small\s+metrics|netflix\s+careers|dataannotation|injobe)\b",
        r"\b(?:salary|compensation|responsibilities|qualifications|hiring|job\s+posting|vacancy|apply\s+now)\b",
    ],
    "trading": [
        r"\b(?:futures\s+trading|order\s+block|smart\s+money|prop\s+firm|bybit|turbo\s+trade|tradingview|crypto\s+fund|gocollect\s+payout|funded\s+accounts|london\s+&\s+new\s+york\s+session|forex|pnl|leverage)\b",
    ],
    "agents": [
        r"\b(?:ai\s+agents?|langgraph|agentmemory|llm\s+wiki|claude\s+code\s+subagents|moltbot|agent-reach|roo\s+code|coding\s+agents|autogen|crewai|superpowers|agentic|multi-agent)\b",
    ],
    "ML": [
        r"\b(?:machine\s+learning|gemma|llama|qwen|transformers|gguf|kquant|vram|rag|100-days-of-ml|pleias-rag|deep\s+learning|fine-tuning|lora|quantization|embeddings|ollama|mamaylm|whisper)\b",
    ],
    "research": [
        r"\b(?:scientific\s+research|arxiv|carbon\s+neutrality|verra|vm0042|benchmark|empirical|academic\s+paper|nuclear\s+weapon|labor\s+market\s+impacts|claims\s+provable|frontier\s+model|methodology\s+breakdown)\b",
    ],
    "workflows": [
        r"\b(?:ai-пайплайн|пайплайн|піраміда\s+тестування|one\s+page\s+test\s+plan|github\s+spec\s+kit|friday\s+night\s+testing|інженерія\s+якості|playwright\s+vs\s+selenium|playwright-ui-api|vibe\s+coded|ci/cd|test\s+automation|testing\s+practices|версіонування\s+api)\b",
    ],
    "cases": [
        r"\b(?:ai\s+engineering\s+mindset|netflix\s+ai|сільпо\s+ai\s+factory|хакатон|як\s+ми\s+скоротили\s+підготовку|як\s+змінилася\s+роль\s+qa|я\s+побудувала\s+ai-пайплайн|case\s+study|revenuecat\s+shipaton)\b",
    ],
    "tools": [
        r"\b(?:toon\s+🎒|token-oriented|vscode\s+extension|markgone|remove\s+watermarks|rentahuman|spoti-flac|flowsurface|skales|petdex|oh\s+my\s+git|postgres|mongodb|desktop\s+app|cli\s+tool|software\s+utility)\b",
    ],
    "hints": [
        r"\b(?:89\s+things\s+i\s+know\s+about\s+git|git\s+для\s+самых\s+маленьких|задачи\s+и\s+решения\s+для\s+бойца\s+postgresql|уроки\s+sql|гайды\s+по\s+python|гайды\s+по\s+бд|qa\s+quiz|собеседовании\s+у\s+qa|що\s+питають\s+на\s+співбесіді|interview\s+questions|quick\s+tips|cheat\s+sheet)\b",
    ],
    "literature": [
        r"\b(?:30\s+days\s+of\s+python|30-seconds-of-python|learn-python|python\s+reference|python-guide|project-based-learning|amazing-python-scripts|awesome-python|book|epam\s+campus|leadership\s+foundations|courses?|tutorial|textbook|guidebook)\b",
    ],
    "repositories": [
        r"\b(?:github\s*-\s*|0xsojalsecanus|coding-problems|self-learning-skills|thealgorithmspython|huggingface\s+spaces|repo|source\s+code)\b",
    ],
    "issues": [
        r"\b(?:attacking\s+mongodb|ipv6\s+penetration\s+testing|bug\s+bounty|vulnerability|exploit|stenography|cve|cident-be-ex|security\s+audit)\b",
    ],
    "ideas": [
        r"\b(?:ai\s+money\s+lab|ai❤️4life|ben\s+horowitz|right\s+product,\s+right\s+time|image\s+to\s+video\s+ai|startup\s+ideas?|business\s+concepts?)\b",
    ],
}

# --- Fixed values: words tried, in order, when no classification pattern matches.
KEYWORD_FALLBACK: list[tuple[str, list[str]]] = [
    ("repositories", ["github.com"]),
    ("workflows", ["podcast", "youtube.com"]),
    ("jobs", ["linkedin.com"]),
]

# --- Fixed values: source routes (name, substrings of the host), first match wins.
ROUTES: list[tuple[str, list[str]]] = [
    ("youtube", ["youtube.com", "youtu.be"]),
    ("arxiv", ["arxiv.org"]),
    ("x", ["x.com", "twitter.com"]),
    ("linkedin", ["linkedin.com"]),
    ("github", ["github.com"]),
]

# --- Fixed values: login-wall patterns, tested in order.
LOGIN_PATTERNS: list[str] = [
    r"\b(?:sign\s*in|log\s*in|login|log\s*on)\b",
    r"\b(?:join\s+linkedin|sign\s+in\s+to\s+linkedin)\b",
    r"\b(?:sign\s+in\s+to\s+x|log\s+in\s+to\s+twitter)\b",
    r"\b(?:войти|авторизация|вход\s+в\s+аккаунт|введите\s+пароль)\b",
    r"\b(?:access\s+denied|captcha|verify\s+you\s+are\s+human)\b",
]

# --- Fixed values: promotional phrases removed from transcripts.
PROMO_PATTERNS: list[str] = [
    r"(?:з\s+питань\s+реклами|по\s+вопросам\s+рекламы|for\s+sponsorships?)\s*[:@-]?\s*\S+",
    r"(?:підписуйтесь|подписывайтесь|subscribe\s+to|follow\s+us\s+on)\s+(?:на\s+)?(?:наш\s+)?(?:канал|telegram|телеграм|youtube|channel|twitter|x\.com)\S*",
    r"(?:don't\s+forget\s+to\s+like|leave\s+a\s+like|hit\s+the\s+bell|ставьте\s+лайки?|тисніть\s+дзвіночок)[^.!?\n]*[.!?\n]?",
    r"(?:link\s+in\s+(?:the\s+)?description|посилання\s+в\s+описі|ссылка\s+в\s+описании)[^.!?\n]*[.!?\n]?",
]

# --- Fixed values: bracketed sound tags removed from transcripts.
SOUND_TAGS: list[str] = [
    "music", "applause", "laughter", "snorts", "cheering", "coughing", "throat clearing", "screaming",
    "sighs", "inaudible", "silence", "whispering", "groans", "crying", "gasping", "chuckle",
]

# --- Fixed values: attribute fragments that mark page clutter.
CLUTTER_CLASS_OR_ID = ["cookie", "consent", "banner"]
CLUTTER_CLASS = ["modal-backdrop", "popup", "signup-prompt"]
CLUTTER_ID = ["layers"]

# --- Fixed values: transcript language preference, and branch names that may hold a readme.
TRANSCRIPT_LANGUAGES = ["en", "uk", "ru", "de", "es", "fr"]
README_BRANCHES = ["HEAD", "main", "master"]

# --- Fixed values: sizes.
MIN_TEXT = 200          # shorter captures fail the integrity check
LOGIN_WINDOW = 1500     # characters searched for login words
MIN_NOTE = 100          # shorter notes count as failed
STUB_NOTE = 300         # failed notes below this are deleted
CORPUS_HEAD = 2000      # characters of a note the classifier reads
EXCERPT_HEAD = 2500     # characters of source text quoted in the compendium
REQUEST_HEAD = 10000    # characters of text sent to the model
HEAD_LINES = 30         # lines searched for the front-matter address
TILE_HEIGHT = 1568
MAX_TILES = 5
MODEL_TILES = 3


_OPEN_REPEAT = re.compile(r"\)(?:[*+]|\{\d+,\})")


def check_pattern(pattern: str) -> str:
    """Refuse a pattern that repeats a group without a bound.

    Java's matcher recurses once per group iteration, so such a pattern can
    overflow the stack of an executor on one long text.
    """
    bare = re.sub(r"\\.|\[(?:\\.|[^\]])*\]", "_", pattern)
    if _OPEN_REPEAT.search(bare):
        raise ValueError(f"pattern repeats a group without a bound, use {{0,n}}: {pattern!r}")
    re.compile(pattern)
    return pattern
