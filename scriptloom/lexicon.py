"""Word lists and patterns.

Fixed values: what follows states the lists, patterns and constants that results depend on.
"""

FILLERS = [
    "um", "uh", "umm", "uhh", "er", "ah", "like", "you know", "i mean", "sort of", "kind of", "basically", "actually", "literally", "right", "okay", "ok", "yeah", "yep", "mhm",
]
TAGS = [
    "[inaudible]", "[crosstalk]", "[laughter]", "[music]", "[applause]", "[silence]", "(inaudible)", "(crosstalk)", "(laughter)", "(laughs)", "(music)", "(applause)", "(silence)", "[unintelligible]", "(unintelligible)",
]
TEMPLATES = [
    r"continuing in our hands[- ]on section",
    r"let's continue with (?:the|our) hands[- ]on",
    r"moving on to (?:the )?next (?:part|section|topic)",
    r"as (?:i|we) mentioned (?:before|earlier)",
    r"like (?:i|we) said",
    r"(?:so|now),? let's move on",
    r"(?:okay|alright),? (?:so|now)",
    r"and that's it for (?:this|that) (?:part|section)",
    r"we(?:'ll| will) get (?:back )?to (?:this|that) later",
    r"we(?:'ll| will) discuss (?:this|that) (?:more )?(?:later|soon)",
]
VISUAL = ["screen shows", "diagram", "slide", "demo", "code", "architecture", "showing"]
TRANSITIONS = [
    r"\b(?:now|next|okay|alright|so),?\s+let'?s\s+",
    r"\bmoving on\b",
    r"\bnow (?:let's|we'll|we will)\b",
    r"\bnext,?\s+(?:we'll|we're|we will|up|step|part|section)\b",
    r"\b(?:first|second|third|finally|lastly)\b",
    r"\bstep \d+\b",
    r"\bpart \d+\b",
    r"\blet's talk about\b",
    r"\blet's discuss\b",
    r"\blet's move (?:on )?to\b",
    r"\bthe next (?:thing|topic|item)\b",
]
QUESTION_WORDS = ["what", "when", "where", "who", "whom", "whose", "why", "how", "which", "can", "could", "would", "should", "is", "are", "do", "does", "did"]
KEYWORD_STOPS = ["the", "and", "for", "with", "this", "that", "from", "will", "have", "your"]
RANK_VERBS = [
    "navigate", "go", "open", "access", "visit", "browse", "click", "select", "choose", "press", "tap", "hit", "type", "enter", "input", "fill", "write", "paste", "configure", "set", "enable", "disable",
    "change", "modify", "adjust", "update", "edit", "create", "add", "insert", "make", "build", "generate", "delete", "remove", "clear", "reset", "restore", "save", "verify", "check", "confirm",
    "validate", "review", "test",
]
SEQUENCE_WORDS = ["first", "second", "third", "next", "then", "after", "finally", "step", "now", "let's", "we'll", "going to"]
SEQUENCE_PATTERNS = [r"\b(first|firstly|1st)\b", r"\b(second|secondly|2nd|then|next)\b", r"\b(third|thirdly|3rd|after\s+that)\b", r"\b(finally|lastly|last|in\s+conclusion)\b"]
STRUCTURE_VERBS = ["click", "open", "navigate", "create", "delete", "update", "select", "choose", "enter", "type", "save", "cancel", "configure", "set", "enable", "disable", "install", "run"]
DECISIONS = ["if", "when", "choose", "select", "whether", "depending"]
ROLES = ["user", "admin", "administrator", "trainer", "manager", "operator"]
BUTTONS = ["button", "click", "submit", "save", "cancel", "ok", "apply"]
CODE_WORDS = ["async", "await", "def", "class", "function", "import", "from", "return", "if", "else", "for", "while", "try", "except", "const", "var", "let", "public", "private", "static", "void"]
TECHNICAL_TERMS = [
    "api", "endpoint", "database", "cosmos", "blob", "storage", "pipeline", "workflow", "microservice", "container", "docker", "kubernetes", "deployment", "configuration", "authentication",
    "authorization", "throughput", "latency", "idempotent", "scalability", "asynchronous", "synchronous", "event", "trigger",
]
TECHNICAL_VERBS = ["click", "select", "open", "navigate", "configure", "create", "delete", "update", "install", "deploy", "build", "run", "execute"]
MATCH_STOPS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "is", "are", "was", "were", "be", "been", "have", "has", "had", "do", "does", "did", "will", "would", "should", "could",
]
BARE_VERBS = ["click", "open", "navigate", "select", "choose", "enter", "type", "create", "delete", "update", "configure", "set", "go"]
PATTERN_VERBS = ["click", "open", "navigate", "select", "choose", "enter", "type", "create", "delete", "update", "configure", "set"]
PUNCTUATION = ".,!?;:()[]{}\"'"
# fixed value: closes short details that agree with the transcript
ALIGNED = " This aligns with the process described in the transcript."
GENERIC_TITLES = [r"^step \d+$", r"^untitled", r"^new step", r"^todo", r"^instructions?$"]
WEAK_VERBS = [
    "learn", "understand", "know", "remember", "recall", "recognize", "comprehend", "grasp", "appreciate", "realize", "familiarize", "review", "read", "study", "examine", "consider", "explore",
    "look at", "check out", "be aware", "keep in mind", "note", "observe", "watch", "see", "view", "ensure", "make sure", "try", "attempt", "work on", "deal with", "handle", "manage", "take care of",
]
STRONG_VERBS = [
    "configure", "set", "enable", "disable", "update", "modify", "adjust", "customize", "change", "edit", "setup", "create", "add", "define", "initialize", "generate", "build", "construct",
    "establish", "develop", "make", "design", "run", "execute", "deploy", "install", "implement", "apply", "launch", "start", "invoke", "trigger", "activate", "navigate", "open", "access",
    "go to", "select", "click", "choose", "pick", "locate", "find", "verify", "test", "validate", "confirm", "check", "monitor", "inspect", "examine", "assess", "evaluate", "remove", "delete",
    "clear", "reset", "uninstall", "deactivate", "stop", "terminate", "kill", "enter", "input", "type", "specify", "provide", "fill", "insert", "paste", "upload", "download", "copy", "organize",
    "arrange", "sort", "group", "categorize", "structure", "order", "prioritize",
]
SUGGESTIONS = {
    "learn": "Complete the tutorial, then configure",
    "understand": "Review the documentation, then implement",
    "review": "Analyze the configuration and update",
    "read": "Open the file and identify",
    "ensure": "Verify",
    "make sure": "Confirm",
    "try": "Execute",
    "attempt": "Run",
    "check out": "Examine",
    "look at": "Open",
    "be aware": "Note",
    "keep in mind": "Remember",
    "familiarize": "Study the documentation, then configure",
}
