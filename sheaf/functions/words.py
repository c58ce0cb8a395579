"""Word lists and tables of the scoring rules. All are fixed values."""

STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "that", "the", "to", "was", "were", "will", "with",
    "this", "but", "they", "have", "had", "what", "said", "each", "which", "she", "do", "how", "their", "if", "up", "out", "many", "then", "them", "these", "so",
)

GENERIC = {
    "update_feature": (
        "new feature", "new features", "latest feature", "latest features", "new update", "new updates", "latest update", "latest updates", "recent update",
        "recent updates", "update", "updates", "feature update", "feature updates", "new release", "new releases", "latest release", "recent release",
        "version update", "upgrade", "enhancement", "enhancements", "improvement", "improvements"),
    "guide_tutorial": (
        "best practices", "best practice", "practices", "tutorial", "guide", "documentation", "announcement", "announcements", "how to", "getting started",
        "quick start", "overview", "introduction", "tips", "tips and tricks", "tutorial guide", "step by step", "walkthrough", "handbook", "reference", "cheat sheet"),
    "general_tech": (
        "development", "coding", "programming", "algorithm", "software", "application", "mobile app", "web app", "app development", "technology", "tech", "digital",
        "innovation", "solution", "solutions", "framework", "library", "tool", "tools", "methodology", "approach", "strategy", "implementation", "architecture",
        "design", "pattern", "patterns"),
    "cloud_aws": (
        "aws", "amazon", "cloud computing", "cloud", "cloud service", "service", "platform", "infrastructure", "deployment", "hosting", "server", "serverless",
        "microservices", "devops", "ci cd", "automation", "monitoring", "logging", "security", "performance", "scalability", "reliability"),
    "business_industry": (
        "enterprise", "business", "industry", "market", "trends", "analysis", "report", "survey", "study", "research", "insights", "data", "analytics", "metrics",
        "kpi", "roi", "cost", "pricing", "budget", "optimization"),
    "time_frequency": (
        "daily", "weekly", "monthly", "quarterly", "annual", "regular", "periodic", "scheduled", "routine", "ongoing", "continuous", "real time", "instant", "immediate"),
    "quality_status": (
        "quality", "testing", "bug", "bugs", "issue", "issues", "problem", "problems", "fix", "fixes", "patch", "patches", "stable", "beta", "alpha", "production",
        "staging", "maintenance", "support", "help", "troubleshooting"),
    "descriptors": (
        "new", "latest", "recent", "modern", "advanced", "simple", "easy", "quick", "fast", "efficient", "powerful", "flexible", "comprehensive", "complete", "full",
        "basic", "essential", "popular", "trending", "top", "best", "recommended"),
    "actions": (
        "learn", "build", "create", "develop", "deploy", "manage", "configure", "setup", "install", "migrate", "integrate", "optimize", "scale", "monitor", "secure",
        "backup", "restore", "troubleshoot", "debug", "test", "validate"),
}

AMBIGUOUS = ("coding", "programming", "software engineers", "algorithm", "development", "aws", "amazon")

#: Topic names to which a theme applies, and keywords of which one has to match. The first that applies counts.
THEMES = (
    (("tiktok",), ("tiktok", "social media", "app development", "mobile app")),
    (("ecs", "eks"), ("ecs", "eks", "kubernetes", "container", "containerization", "aws ecs", "aws eks", "amazon ecs", "amazon eks")),
    (("engineering culture", "management"), ("leadership", "management", "culture", "team", "workplace", "emotional intelligence")),
)

HIGH_CONTENT = (
    r"documentation|tutorial|guide|best\s+practices", r"implementation|example|code\s+sample", r"official|announcement|release\s+notes",
    r"technical\s+analysis|deep\s+dive|comprehensive",
)
LOW_CONTENT = (r"breaking|urgent|must\s+read|trending", r"top\s+\d+|list\s+of|ranked", r"opinion|rant|controversial", r"quick\s+tip|life\s+hack|simple\s+trick")
GOOD_DOMAINS = ("github.com", "stackoverflow.com", "medium.com", "dev.to", "docs.aws.amazon.com", "cloud.google.com", "azure.microsoft.com")
BAD_URL = r"clickbait|listicle|sponsored|advertisement|\d+\s+reasons?\s+why|you\s+won'?t\s+believe|shocking|amazing|incredible"

ERROR_TYPES = {
    "network": ("ConnectionError", "TimeoutError", "HTTPError", "URLError", "ConnectTimeout", "ReadTimeout"),
    "database": ("DatabaseError", "IntegrityError", "OperationalError", "ProgrammingError", "DataError"),
    "resource": ("MemoryError", "OSError", "PermissionError", "FileNotFoundError"),
    "authentication": ("AuthenticationError", "PermissionDenied", "Unauthorized"),
    "processing": ("ValueError", "TypeError", "KeyError", "AttributeError"),
}
ERROR_MESSAGES = {
    "network": ("connection", "timeout", "network", "dns", "socket", "http", "ssl", "certificate", "proxy"),
    "database": ("database", "sql", "table", "column", "constraint", "sqlite", "postgres", "mysql"),
    "telegram": ("telegram", "bot", "chat", "message", "channel", "token", "webhook"),
    "feed": ("rss", "feed", "xml", "parse", "malformed", "entry", "article"),
    "authentication": ("api key", "token", "auth", "permission", "unauthorized", "forbidden", "credential"),
    "configuration": ("config", "setting", "environment", "variable", "missing", "invalid"),
}

PROVIDER_FACTORS = {"groq": 1.0, "deepseek": 1.0, "gemini": 1.0, "openai": 1.0, "keyword_fallback": 0.45}
PROVIDER_ORDER = ("groq", "deepseek", "gemini", "openai")
