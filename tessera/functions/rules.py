"""Rule tables as data.

FIXED VALUES — these lists must equal the reference's for identical
results; they are stated plainly, in the reference's natural order.
"""

# FIXED VALUES: stop words of the keyword scan.
KEYWORD_STOP_WORDS = [
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "do", "did", "will", "would", "could", "should",
    "may", "might", "shall", "can", "need", "to", "of", "in", "for", "on",
    "with", "at", "by", "from", "as", "into", "through", "during", "before", "after",
    "above", "below", "between", "out", "off", "over", "under", "again", "further", "then",
    "once", "here", "there", "when", "where", "why", "how", "all", "each", "every",
    "both", "few", "more", "most", "other", "some", "such", "no", "nor", "not",
    "only", "own", "same", "so", "than", "too", "very", "just", "because", "but",
    "and", "or", "if", "while", "about", "explain", "describe", "what", "which",
    "tell", "show", "find", "get", "please", "this", "that", "these", "those", "it",
    "its", "my", "your", "our", "their", "current", "flow", "work",
]

# FIXED VALUES: stop words of the full-text query builder.
FULLTEXT_STOP_WORDS = [
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "have",
    "has", "had", "do", "did", "will", "would", "could", "should",
    "may", "might", "shall", "can", "to", "of", "in", "for", "on",
    "with", "at", "by", "from", "as", "into", "through", "and", "or",
    "but", "not", "this", "that", "it", "its", "my", "your", "our", "their",
    "explain", "describe", "what", "which", "how", "tell", "show", "find",
    "current", "flow", "please", "just", "get", "work",
]

# FIXED VALUES: punctuation trimmed from both ends of a query word.
WORD_TRIM_CHARS = ".,!?;:'\"()[]{}/\\"

# FIXED VALUES: path segments that are never tags.
STOP_TAGS = ["aider", "coders", "src", "lib", "test", "tests", "cmd", "internal"]

# FIXED VALUES: directories pruned from a corpus walk.
PRUNED_DIRS = [".git", "node_modules", "vendor", ".venv", "venv", "__pycache__",
               ".next", "dist", "build", "target", ".idea", ".vscode", ".DS_Store"]

# FIXED VALUES: well-known files and folders of a repository, best first.
README_NAMES = ["README.md", "README.txt", "README", "Readme.md", "readme.md"]
DOCS_DIRS = ["docs", "doc", "documentation"]
TESTS_DIRS = ["tests", "test", "__tests__", "spec"]
