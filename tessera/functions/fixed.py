"""Word lists, patterns, weights and formats that results depend on."""

from __future__ import annotations

# --- Files ---------------------------------------------------------------------
EXTENSIONS = ["js", "jsx", "ts", "tsx"]
EXCLUDED_DIRS = ["node_modules", ".git", "dist", "build", ".next", "coverage", "__pycache__", ".vite", ".cache"]
#: In this order: the first hint inside a part of the path decides.
TYPE_HINTS = [("hook", "HOOK"), ("context", "CONTEXT"), ("store", "STORE"), ("reducer", "STORE"), ("route", "ROUTE"), ("page", "PAGE"), ("pages", "PAGE"), ("component", "COMPONENT")]
LANGUAGES = {"ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript"}

# --- Chunks --------------------------------------------------------------------
MAX_CHUNK_TOKENS, MIN_CHUNK_TOKENS, OVERLAP_TOKENS, CHUNK_LINES = 300, 20, 30, 61
ALWAYS_KEPT = ["COMPONENT", "HOOK", "IMPORT_BLOCK"]
NOISE = [
    "import", "export", "default", "from", "as", "const", "let", "var", "function", "return", "class", "extends", "new", "this", "super",
    "if", "else", "for", "while", "do", "switch", "case", "break", "async", "await", "try", "catch", "finally", "throw",
    "true", "false", "null", "undefined", "React", "props", "children", "state",
]
MIN_SYMBOL = 3
FUNCTION = r"(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+(\w+)\s*\("
ARROW = r"(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\("
#: What each match of these has.
FUNCTION_HAS, ARROW_HAS = r"function\s", r"=\s*(?:async\s*)?\("
DECLARED = r"(?:function\s+|const\s+)(\w+)"
HOOK_CALL, JSX_TAG, CAMEL_CALL = r"\b(use[A-Z][a-zA-Z0-9]+)\b", r"<([A-Z][a-zA-Z0-9_]*)\b", r"\b([a-z][a-zA-Z]{3,})\s*[\.\(]"
IMPORTED = r"\b([A-Za-z_$][a-zA-Z0-9_$]+)\b"

# --- Calls and edges -----------------------------------------------------------
FETCH = r"(?s)fetch\s*\(\s*[`'\"]([^`'\"]+)[`'\"]\s*(?:,\s*\{[^}]*method\s*:\s*['\"](\w+)['\"][^}]*)?\)"
AXIOS = r"(?i)axios\s*\.\s*(get|post|put|patch|delete|head)\s*\(\s*[`'\"]([^`'\"]+)[`'\"]"
FETCH_TEMPLATE = r"(?s)fetch\s*\(\s*`([^`$]+)(?:\$\{[^}]+\})?[^`]*`"
USE_QUERY = r"(?s)use(?:Query|Mutation)\s*\([^)]*[`'\"]([/\w\-]+)[`'\"]"
BASE_URL = r"baseUrl\s*:\s*[`'\"]([^`'\"]+)[`'\"]"
IMPORT_FROM, EDGE_HOOK, EDGE_TAG = r"from\s+['\"]([^'\"]+)['\"]", r"\b(use[A-Z]\w+)\b", r"<([A-Z][A-Za-z0-9_]*)\b"
ROUTE = r"<Route[^>]*path=['\"]([^'\"]+)['\"][^>]*element=\{\s*<\s*([A-Z][A-Za-z0-9_]*)"
USE_CONTEXT, USE_STATE = r"useContext\((\w+)\)", r"\b(useState|useReducer)\b"
EDGE_WEIGHTS = {"IMPORTS": 1.0, "USES_HOOK": 0.9, "CONSUMES_CONTEXT": 0.8, "RENDERS": 0.7, "MANAGES_STATE": 0.5}
ROUTE_WEIGHTS = (1.0, 0.9)  # from the file's first component, from the chunk

# --- Search --------------------------------------------------------------------
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
POOL, SYMBOLS, SCAN, SEEDS, TERMS, FRONTIER, GRAPH_EDGES = 50, 20, 500, 10, 20, 512, 1000
SYMBOL_SCORE, DECAY, ROUTE_DECAY = 2.0, 0.65, 0.85
STOP_WORDS = ["who", "what", "where", "why", "how", "is", "are", "the", "a", "an", "does", "did", "to", "in", "on", "at", "all", "using", "places", "files", "affect", "handled", "this"]
IDENTIFIER = r"\b[a-z][a-zA-Z0-9]+[A-Z][a-zA-Z0-9]*\b|\b[A-Z][a-zA-Z0-9]+\b"
SYNONYMS = {
    "logout": ["signout", "sign out", "log out", "deauthenticate"],
    "login": ["signin", "sign in", "authenticate", "auth"],
    "auth": ["authentication", "authorization", "login", "token", "jwt", "session"],
    "theme": ["useTheme", "ThemeProvider", "darkmode", "lightmode", "palette"],
    "route": ["routing", "navigate", "useNavigate", "Link", "path", "page"],
    "state": ["useState", "useReducer", "redux", "store", "zustand", "context"],
    "fetch": ["api", "axios", "useQuery", "http", "endpoint", "request"],
    "render": ["rerender", "rerenders", "component", "jsx", "return"],
    "sidebar": ["Sidebar", "nav", "navigation", "drawer", "panel"],
    "calendar": ["Calendar", "schedule", "date", "datepicker"],
    "dashboard": ["Dashboard", "DashboardContent", "main page"],
    "authentication": ["login", "auth", "session", "jwt", "token", "LoginSwitcher"],
}
EXPANSIONS = {
    "auth": ["authentication", "login", "token", "JWT", "session", "credentials", "LoginSwitcher"],
    "theme": ["useTheme", "ThemeProvider", "darkmode", "lightmode", "palette", "colors"],
    "state": ["useState", "useReducer", "store", "Redux", "Zustand", "atoms"],
    "routing": ["Route", "useNavigate", "useLocation", "Link", "history", "path"],
    "fetch": ["API", "axios", "useQuery", "fetch", "REST", "HTTP", "endpoint"],
    "render": ["JSX", "return", "component", "DOM", "React"],
    "logout": ["signout", "deauthenticate", "logout", "session", "clearToken"],
    "login": ["signin", "authenticate", "LoginSwitcher", "credentials"],
    "sidebar": ["Sidebar", "nav", "navigation", "drawer"],
    "calendar": ["Calendar", "schedule", "date", "DatePicker"],
    "dashboard": ["Dashboard", "DashboardContent", "TeacherDashboard"],
}
HIGH_VALUE = [
    r"\buseState\b", r"\buseEffect\b", r"\buseContext\b", r"\buseCallback\b", r"\buseMemo\b", r"\buseReducer\b",
    r"\baxios\b|\bapi\.\b|\bfetch\(", r"\bnavigate\b|\buseNavigate\b", r"\bcontext\b|\bProvider\b",
    r"\bonClick\b|\bonChange\b|\bonSubmit\b", r"\brouter\b|\bRoute\b",
]
TYPE_BOOST = {"HOOK": 0.15, "COMPONENT": 0.10, "FUNCTION": 0.10, "CLASS": 0.05}

# --- Intents: rules, keywords, strategy (lexical, semantic, graph, depth, top k, use graph, reverse, edge types) ---
INTENTS = {
    "symbol_lookup": {
        "rules": [r"\bwhere is\b", r"\bfind\b.{0,50}\b(function|component|hook|file|class|places|all)\b", r"\bshow me\b.{0,30}\b(definition|code|impl)\b", r"\bwhere (is|are|does)\b.{0,30}\bdefined\b", r"\blocate\b", r"\ball places\b", r"\ball (files|components|uses)\b", r"\busing\b.{0,20}\b[a-z][a-zA-Z]{3,}\b"],
        "keywords": ["find", "where", "locate", "show", "all places", "using", "which"],
        "strategy": (0.7, 0.2, 0.1, 1, 5, False, False, []),
        "exemplars": ["where is the login function", "find the useAuth hook"],
    },
    "architecture": {
        "rules": [r"\bhow does\b", r"\bexplain\b", r"\bwhat is the flow\b", r"\barchitecture\b", r"\bwalk me through\b", r"\boverview\b"],
        "keywords": ["how", "explain", "flow", "architecture", "overview"],
        "strategy": (0.2, 0.3, 0.5, 3, 10, True, False, []),
        "exemplars": ["how does authentication work", "explain the routing flow"],
    },
    "modification_guidance": {
        "rules": [r"\bwhere should I\b", r"\bhow (do I|can I|to)\b", r"\bwhere (to|would I).{0,20}\badd\b", r"\bimplement\b", r"\bintegrate\b", r"\badd\b.{0,30}\b(feature|component|page|button|calendar|logout|login)\b", r"\bcreate\b.{0,20}\b(feature|component|page)\b"],
        "keywords": ["add", "implement", "create", "integrate", "build"],
        "strategy": (0.3, 0.5, 0.2, 2, 8, True, False, []),
        "exemplars": ["where should I add dark mode", "how to add a feature"],
    },
    "debugging": {
        "rules": [r"\bwhy (is|does|did|might|would|could)\b.{0,40}\b(not|fail|broken|error|missing|wrong|never)\b", r"\bwhat.{0,10}wrong\b", r"\bdebug\b", r"\bissue\b", r"\bfix\b", r"\bbug\b", r"\bnot (get|being|work|show|fire|trigger|mark|run)\b", r"\bfail(s|ed|ing)?\b", r"\bnever (fires?|runs?|works?|triggers?|marks?)\b", r"\bwhy might\b", r"\bnot getting\b", r"\bwon't\b", r"\bdoesn't\b.{0,20}\b(work|fire|run|trigger)\b"],
        "keywords": ["why", "broken", "fail", "debug", "fix", "issue", "not get", "not mark", "never", "doesn't", "won't", "missing"],
        "strategy": (0.4, 0.4, 0.2, 2, 10, True, False, []),
        "exemplars": ["why is the login broken", "fix the state issue"],
    },
    "rerender_analysis": {
        "rules": [r"\brerender\b", r"\bre-render\b", r"\bunecessary render\b", r"\bwhy.{0,20}render\b", r"\bperformance.{0,20}render\b", r"\bmemo\b.*\brender\b"],
        "keywords": ["rerender", "render", "performance", "memo"],
        "strategy": (0.3, 0.4, 0.3, 2, 8, True, False, ["MANAGES_STATE", "USES_HOOK", "RENDERS"]),
        "exemplars": ["why does Dashboard rerender", "unnecessary render"],
    },
    "route_tracing": {
        "rules": [r"\broute\b", r"\b\/[a-z\-\/]+\b", r"\bpage\b.{0,20}\bflow\b", r"\bnavigat\b", r"\bwhich files.{0,20}(route|affect)\b", r"\bfiles affect\b"],
        "keywords": ["route", "files affect", "page", "navigate", "which files"],
        "strategy": (0.2, 0.2, 0.6, 4, 10, True, False, ["DEFINES_ROUTE", "RENDERS", "IMPORTS"]),
        "exemplars": ["which files affect /profile route", "route flow"],
    },
    "impact_analysis": {
        "rules": [r"\bwhat (breaks|changes)\b", r"\bwhat depends on\b", r"\bimpact\b", r"\baffect\b", r"\bif I (change|remove|modify)\b", r"\bdependencies of\b"],
        "keywords": ["impact", "affect", "depends", "breaks", "change"],
        "strategy": (0.2, 0.2, 0.6, 3, 10, True, True, []),
        "exemplars": ["what breaks if I change useAuth", "impact of removing store"],
    },
}
DEFAULT_INTENT = "architecture"

# --- Prompts and service -------------------------------------------------------
INSTRUCTION = "\nAnswer the user's question using only the evidence above. Be concise and cite file paths and line numbers when relevant."
MAX_CONTEXT_TOKENS, LEAST_TAIL_TOKENS, CACHE_TTL_SECONDS, THROTTLE_SECONDS, DIMS = 4096, 50, 3600, 3.0, 384
