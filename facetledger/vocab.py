"""Word lists, prices, markers and crosswalks that results depend on."""

# Lower-case fragments of a working directory.
PERSONAL_FRAGMENTS = (
    "/personal/", "/documents/personal", "/taxes/", "/recipes/", "/health/", "/journal/", "/finances/",
)
BUSINESS_FRAGMENTS = ("/dev/", "/src/", "/projects/", "/work/", "/code/", "/repos/", "/workspace/")

# Domain keywords, matched as substrings; ties go to the earlier domain.
DOMAIN_KEYWORDS = {
    "engineering": ("code", "function", "class", "bug", "refactor", "api", "database", "deploy"),
    "legal": ("contract", "clause", "plaintiff", "statute", "patent", "litigation"),
    "marketing": ("campaign", "brand", "copy", "audience", "seo"),
    "finance": ("budget", "forecast", "revenue", "invoice", "ledger"),
}

# Git branch prefix -> activity.
BRANCH_ACTIVITY = {
    "fix/": "investigating",
    "bug/": "investigating",
    "hotfix/": "investigating",
    "feature/": "building",
    "feat/": "building",
    "refactor/": "improving",
    "cleanup/": "improving",
    "perf/": "improving",
    "test/": "verifying",
    "docs/": "communicating",
    "chore/": "configuring",
    "ci/": "configuring",
}
TEST_PATH_MARKS = ("_test.", "test_", "_spec.")

# Fixed value: ticket codes such as ABC-123.
TICKET_PATTERN = r"\b([A-Z][A-Z0-9]{1,9}-\d{2,5})\b"

# Tag keywords, matched as whole words.
TAG_KEYWORDS = {
    "sports": (
        "basketball", "nba", "football", "soccer", "baseball", "hockey", "tennis", "golf", "athlete",
        "athletes", "playoff", "playoffs", "championship", "championships", "league", "leagues", "stadium",
        "stadiums", "coach", "coaches", "quarterback", "striker", "goalkeeper",
    ),
    "entertainment": (
        "movie", "movies", "film", "films", "tv show", "tv shows", "anime", "manga", "comic", "comics",
        "novel", "novels", "fiction", "poetry", "podcast", "podcasts",
    ),
    "video-games": (
        "playstation", "xbox", "nintendo", "minecraft", "fortnite", "video game", "video games",
        "console game", "speedrun",
    ),
    "music": (
        "song", "songs", "concert", "concerts", "album", "albums", "playlist", "playlists", "guitar",
        "piano", "spotify",
    ),
    "travel": (
        "flight", "flights", "hotel", "hotels", "vacation", "vacations", "itinerary", "airbnb", "passport",
        "destination", "destinations",
    ),
    "food": (
        "recipe", "recipes", "restaurant", "restaurants", "meal", "meals", "cooking", "baking",
        "ingredient", "ingredients",
    ),
    "family": (
        "wedding", "weddings", "birthday", "birthdays", "parenting", "kids", "newborn", "toddler",
        "toddlers", "marriage", "divorce", "spouse",
    ),
    "pets": (
        "puppy", "puppies", "kitten", "kittens", "veterinary", "veterinarian", "pet food", "house pet",
        "house pets",
    ),
    "sensitive": (
        "salary", "salaries", "fired", "layoff", "layoffs", "lawsuit", "lawsuits", "legal dispute",
        "diagnosis", "therapy", "mental health", "prescription", "prescriptions", "confidential", "secret",
        "secrets", "password", "passwords", "credential", "credentials", "ssn",
    ),
    "engineering": (
        "refactor", "refactoring", "api endpoint", "rest api", "graphql", "repository", "repositories",
        "pull request", "pull requests", "merge commit", "merge conflict", "docker", "kubernetes", "k8s",
        "microservice", "microservices", "database schema", "db migration", "stack trace", "deployment",
        "ci/cd",
    ),
}

# Short replies that carry no topic of their own.
FOLLOWER_PHRASES = (
    "yes", "no", "ok", "sure", "thanks", "thank you", "agreed", "right", "exactly", "done", "got it",
    "sounds good", "correct", "yep", "nope", "absolutely", "definitely", "i think so", "that works",
)

# Allowed labels of annotations.
CONTEXT_VALUES = ("personal", "business", "unknown")
DOMAIN_VALUES = ("engineering", "marketing", "finance", "legal", "health", "unknown")
ACTIVITY_VALUES = (
    "investigating", "building", "improving", "verifying", "researching", "planning", "communicating",
    "configuring", "reviewing", "coordinating", "unknown",
)
# Labels outside the list that are read as a near one.
ACTIVITY_REPAIRS = {"debugging": "investigating", "refactoring": "improving", "learning": "researching"}

# Dollars per million tokens (input, output).
MODEL_PRICES = {
    "claude-sonnet-4-20250514": (3.0, 15.0),
    "claude-opus-4-20250514": (15.0, 75.0),
    "claude-haiku-4-20250506": (0.80, 4.0),
}
FAMILY_PRICES = {
    "claude-sonnet": (3.0, 15.0),
    "claude-opus": (15.0, 75.0),
    "claude-haiku": (0.80, 4.0),
}
DEFAULT_PRICE = (3.0, 15.0)
WALKER_PRICES = {"kimi-k2-thinking-turbo": (0.60, 3.00)}
BATCH_PRICES = {"input": 3.0, "output": 15.0, "cache_creation": 3.75, "cache_read": 0.30}
BATCH_DISCOUNT = 0.5

# Signs that a message is a transcript handed to another agent.
TRANSCRIPT_MARKERS = (
    "<transcript>", "</transcript>", "<conversation_summary>", "Below is a transcript of the conversation",
    "Summarize the following conversation", "Compact the following conversation",
)
TRANSCRIPT_LENGTH = 8000
SESSION_HEADERS = ("x-claude-code-session-id", "X-Claude-Code-Session-Id")
API_LOG_AGENT = "claude-code"
TRANSCRIPT_SKIP = "skipped: meta-agent payload"

# Accepted spellings of each token counter, first present one wins.
TOKEN_ALIASES = {
    "input": ("input", "input_tokens"),
    "output": ("output", "output_tokens"),
    "cache_creation": ("cache_creation", "cache_creation_input_tokens", "cache_creation_tokens"),
    "cache_read": ("cache_read", "cache_read_input_tokens", "cache_read_tokens"),
}

# Short words of the status label.
ACTIVITY_WORDS = {
    "investigating": "debug",
    "building": "build",
    "improving": "refine",
    "verifying": "verify",
    "researching": "research",
    "planning": "plan",
    "communicating": "write",
    "configuring": "config",
    "reviewing": "review",
    "coordinating": "coord",
}
DOMAIN_WORDS = {
    "engineering": "eng",
    "marketing": "mktg",
    "finance": "fin",
    "legal": "legal",
    "unattributed": "",
    "unknown": "",
}

# Least similarity a path must keep at each level, the last one for all deeper levels.
LEVEL_THRESHOLDS = (0.85, 0.75, 0.65, 0.55)

# Suffixes dropped when labels of two taxonomies are compared.
LABEL_SUFFIXES = ("-fan", "-focus", "-personal", "-corp")

# Crosswalks from weak labels to accepted labels.
L1_LEAVES = {
    "Agent": ("career", "education", "family", "parenting"),
    "Device": ("gadgets", "engineering"),
    "Event": ("news", "entertainment"),
    "Place": ("travel", "geography"),
    "Species": ("pets", "nature", "science-technology"),
    "SportsSeason": ("sports", "basketball", "soccer", "american-football", "baseball", "hockey"),
    "TopicalConcept": ("science-technology", "education"),
    "UnitOfWork": ("art-hobbies", "books-literature"),
    "Work": ("movies-tv", "music", "books-literature", "video-games"),
}
TOPIC_GROUPS = {
    "Sports": ("sports",),
    "Movies&Tv": ("entertainment",),
    "Music": ("music",),
    "VideoGames": ("video-games",),
    "Travel": ("travel",),
    "Food": ("food",),
    "Family&Relationships": ("family",),
    "Animals&Pets": ("pets",),
    "Health&Medicine": ("sensitive",),
    "Psychology": ("sensitive",),
    "Depression": ("sensitive",),
    "Finance": (),
    "Job": ("sensitive",),
}
# Scenarios not listed map to "unknown".
SCENARIO_DOMAIN = {"iot": "engineering"}
SCENARIO_TAGS = {"cooking": ("food",), "music": ("music",), "takeaway": ("food",), "transport": ("travel",)}
FORUM_TOPIC_TAGS = {
    "Sports": (
        "basketball", "soccer", "american-football", "baseball", "hockey", "tennis", "golf", "running",
        "cycling", "fitness",
    ),
    "Science & Mathematics": ("physics", "chemistry", "biology", "math", "science-technology", "astronomy"),
    "Health": ("fitness", "nutrition", "mental-health", "medical", "weight", "sleep", "therapy", "stress"),
    "Education & Reference": ("languages", "tutoring", "school-age-kids", "courses", "academic"),
    "Computers & Internet": (
        "engineering", "software", "hardware", "frontend", "backend", "databases", "devops", "ai-ml",
    ),
    "Entertainment & Music": ("movies-tv", "music", "books-literature", "video-games", "celebrities"),
    "Business & Finance": (
        "investing", "banking", "budgeting", "career", "entrepreneurship", "real-estate",
    ),
    "Family & Relationships": ("parenting", "marriage", "dating", "family", "friendships"),
    "Politics & Government": ("politics", "policy", "elections"),
}
WEAK_SCENARIO_TAGS = {
    "music": ("music",),
    "cooking": ("food", "recipes"),
    "takeaway": ("food",),
    "transport": ("travel",),
    "news": ("news",),
    "weather": ("weather",),
}

# Grid of the threshold sweep.
SWEEP_SIMILARITIES = (0.20, 0.25, 0.27, 0.30, 0.33, 0.35, 0.40)
SWEEP_TOP_N = (5, 7, 10)
