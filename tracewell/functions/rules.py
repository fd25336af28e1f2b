"""Fixed values the analyses depend on.

Everything here is data, not logic: word lists, type names, scores. Callers may
pass their own lists wherever a function takes one as a parameter.
"""

from dataclasses import dataclass

# Words that are never a column reference inside an expression.
EXPRESSION_KEYWORDS = [
    "nvl", "case", "when", "then", "else", "end", "and", "or", "not",
    "null", "is", "between", "like", "in", "exists", "select", "from",
    "where", "group", "by", "order", "having", "distinct", "as",
    "current_date", "current_timestamp",
]

# Words of window frames, sort order, joins and literals; never columns either.
CLAUSE_WORDS = [
    "over", "partition", "rows", "range", "unbounded", "preceding", "following",
    "current", "row", "asc", "desc", "nulls", "first", "last", "true", "false",
    "interval", "ilike", "rlike", "escape", "within", "ignore", "respect", "filter",
    "any", "all", "current_time", "current_user", "sysdate", "on", "using", "join",
    "inner", "left", "right", "full", "outer", "cross", "union", "intersect", "except",
    "limit", "offset", "with", "set", "values", "into", "qualify", "default",
]

# Root expression types that make a column derived even with a single source.
DERIVED_EXPRESSION_TYPES = [
    "Case", "Coalesce", "Add", "Mul", "Div", "Sub", "Binary",
    "Anonymous", "Window", "Min", "Max", "Sum", "Count", "Avg",
]

# Expression types kept in API results; any other becomes null.
RESULT_EXPRESSION_TYPES = [
    "SUM", "CASE", "COALESCE", "CONCAT", "WINDOW", "LITERAL", "CURRENTTIMESTAMP",
    "CAST", "MUL", "DIV", "ADD", "GROUPCONCAT", "COUNT", "MAX", "MIN", "AVG",
    "DATEDIFF", "PAREN",
]

# Function name -> root expression type; other functions are Anonymous.
FUNCTION_TYPES = {
    "COALESCE": "Coalesce", "NVL": "Coalesce", "IFNULL": "Coalesce",
    "SUM": "Sum", "COUNT": "Count", "AVG": "Avg", "MIN": "Min", "MAX": "Max",
    "CONCAT": "Concat", "LISTAGG": "GroupConcat", "STRING_AGG": "GroupConcat",
    "DATEDIFF": "DateDiff", "CAST": "Cast", "TRY_CAST": "TryCast",
    "CURRENT_TIMESTAMP": "CurrentTimestamp", "CURRENT_DATE": "CurrentDate",
}

# Aggregates whose single argument names the original column.
NAME_KEEPING_AGGREGATES = ["max", "min", "sum", "count", "avg", "first_value", "last_value"]

# Values that count as missing in report files.
NULL_LIKE = ["null", "none", "n/a", "na", ""]

# Words that are never table names in SQL found inside program code.
TABLE_STOP_WORDS = [
    "select", "from", "where", "join", "inner", "left", "right", "full", "outer", "on",
    "insert", "into", "values", "update", "set", "delete", "create", "alter", "drop",
    "table", "view", "index", "and", "or", "not", "in", "is", "null", "like", "as",
    "group", "by", "order", "having", "limit", "offset", "union", "distinct", "case",
    "when", "then", "else", "end", "exists", "count", "sum", "avg", "min", "max", "for",
    "if", "with", "primary", "key", "foreign", "references", "constraint",
]

# Words counted when deciding whether a string is SQL.
SQL_HINT_WORDS = [
    "SELECT", "FROM", "INSERT", "UPDATE", "DELETE", "WITH", "JOIN", "WHERE",
    "CREATE", "ALTER", "DROP",
]

# Shapes that make a string SQL on their own.
SQL_SHAPES = [
    r"\bSELECT\s+.*\bFROM\b",
    r"\bINSERT\s+INTO\b",
    r"\bUPDATE\s+.*\bSET\b",
    r"\bDELETE\s+FROM\b",
    r"\bWITH\s+\w+\s+AS\s*\(",
]

# Repository name patterns, matched from the start, case-insensitive.
FRONTEND_REPOSITORY_PATTERNS = [
    ".*-frontend$", ".*-ui$", ".*-web$", ".*-client$",
    "frontend-.*", "ui-.*", "web-.*", "client-.*",
]
BACKEND_REPOSITORY_PATTERNS = [
    ".*-backend$", ".*-api$", ".*-server$", ".*-service$",
    "backend-.*", "api-.*", "server-.*", "service-.*",
]

# Functions whose names contain one of these words are taken for service functions.
PROCEDURE_FUNCTION_HINTS = ["service", "run_"]


@dataclass(frozen=True)
class RouteRules:
    """How the path of a router file becomes a URL prefix.

    ``root`` comes first, then each of ``folders`` that is in the path, then the value of the first
    of ``files`` whose key is in the file name. ``exact`` gives the whole prefix of a file name.
    """

    root: str = ""
    folders: tuple[str, ...] = ()
    files: tuple[tuple[str, str], ...] = ()
    exact: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class AppRules:
    """What is particular to one application's code; nothing is by default.

    ``url_bases`` gives the path that a template variable stands for, ``root`` the path that calls and routes share and
    that matching leaves out, ``url_words`` words that mark a text as a URL beside a slash, and ``model_prefixes`` what
    may stand before a model's name.
    """

    url_bases: tuple[tuple[str, str], ...] = ()
    root: str = ""
    url_words: tuple[str, ...] = ()
    model_prefixes: tuple[str, ...] = ()


# Argument names that never hold a URL.
NON_URL_VARIABLES = [
    "data", "body", "payload", "params", "formData", "config", "options", "headers",
    "rest", "args",
]

# Type words that mark a response field as simple.
SIMPLE_TYPE_WORDS = [
    "str", "int", "float", "bool", "datetime", "date", "time",
    "Optional", "List", "Dict", "Any", "Union", "Literal",
    "list", "dict", "set", "tuple",
]
