"""The patterns that unsafe code and calls of functions that don't exist are found by."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Pattern:
    id: str
    regex: str
    message: str
    advice: str
    confidence: float = 0.9
    cwe: str | None = None
    owasp: str | None = None
    any_case: bool = False
    excused: tuple[str, ...] = field(default=())  # a line that one of these matches isn't a finding
    secret: bool = False  # not looked for in paths of tests and samples
    needs: tuple[str, ...] = ()  # of each, one of what | separates is part of whatever the regex matches, in any case if any_case: other files aren't searched

    @property
    def source(self) -> str:
        return ("(?i)" if self.any_case else "") + self.regex


_INJECTION, _CRYPTO = "A03:2021-Injection", "A02:2021-Cryptographic Failures"
_NO_SECRET = (r"process\.env", "(?i)example", "(?i)placeholder", r"(?i)xxx+", r"\.\.\.+", "(?i)mock|stub|fake|fixture|factory", "(?i)seed|sample|demo|dummy", r"describe\s*\(", r"it\s*\(", r"expect\s*\(")
_QUOTE = "['\"`]"

UNSAFE = (
    Pattern("eval-usage", r"\beval\s*\(", "A string is run as code by eval().", "Parse data with JSON.parse(), or call a function instead.", 0.95, "CWE-95", _INJECTION, excused=(
        "['\"]eval['\"]", r"\.\$\$?eval\s*\(", r"['\"].*eval\(\).*['\"]", "(?i)message.*eval", "(?i)usage detected", "(?i)is a major security risk", "(?i)description.*eval", "(?i)suggestion.*eval"), needs=("eval",)),
    Pattern("new-function", r"\bnew\s+Function\s*\(", "Code is made of a string by new Function().", "Use a closure.", 0.9, "CWE-95", _INJECTION, needs=("Function",)),
    Pattern("innerhtml-assignment", r"\.innerHTML\s*[+]?=", "Markup is assigned to innerHTML unchecked.", "Assign textContent, or sanitize first.", 0.85, "CWE-79", _INJECTION, excused=(r"DOMPurify\.sanitize", "sanitizeHtml", r"sanitize\s*\(", r"xss\s*\("), needs=(".innerHTML",)),
    Pattern("outerhtml-assignment", r"\.outerHTML\s*[+]?=", "Markup is assigned to outerHTML unchecked.", "Build nodes, or sanitize first.", 0.85, "CWE-79", _INJECTION, needs=(".outerHTML",)),
    Pattern("document-write", r"\bdocument\.write\s*\(", "Markup is written into the document.", "Append nodes instead.", 0.8, "CWE-79", _INJECTION, needs=("document.write",)),
    Pattern("sql-concat-plus", r"(?:SELECT|INSERT|UPDATE|DELETE|DROP|ALTER|CREATE|TRUNCATE|EXEC)\s+.*\+\s*(?:\w+|\()", "A query is put together with +.", "Bind parameters.", 0.8, "CWE-89", _INJECTION, True, needs=("+", "select|insert|update|delete|drop|alter|create|truncate|exec")),
    Pattern("sql-template-literal", r"`\s*(?:SELECT|INSERT\s+INTO|UPDATE|DELETE\s+FROM|DROP|ALTER|TRUNCATE)\s+.*\$\{", "A query is a template with values in it.", "Bind parameters.", 0.85, "CWE-89", _INJECTION, True, excused=("(?i)Failed to", "(?i)Error:", r"console\.", r"throw\s+new", "(?i)message", r"(?i)log(?:Error|Warn|Info|Debug)?\s*\("), needs=("`", "${")),
    Pattern("hardcoded-api-key", rf"(?:api[_-]?key|apikey)\s*[:=]\s*{_QUOTE}[A-Za-z0-9_\-./+]{{8,}}{_QUOTE}", "An API key is part of the code.", "Read it from the environment.", 0.85, "CWE-798", _CRYPTO, True, (*_NO_SECRET, "(?i)your[_-]?api[_-]?key"), True, needs=("api", "key")),
    Pattern("hardcoded-password", rf"(?:password|passwd|pwd)\s*[:=]\s*{_QUOTE}[^'\"`\s]{{4,}}{_QUOTE}", "A password is part of the code.", "Read it from the environment.", 0.8, "CWE-798", _CRYPTO, True, (
        *_NO_SECRET, "(?i)your[_-]?password", "(?i)password123", r"\*{3,}", r"`[^`]*\$\{", r"Date\.now\(\)", r"Math\.random\(\)", r"['\"]Password['\"]\s*:", "(?i)i18n|translate|locale|intl", r"\.json['\"]\s*$", "(?i)assert",
        "(?i)defaultPassword|initialPassword|resetPassword", r"type\s*[:=]\s*['\"]password['\"]", r"\.setAttribute\s*\(\s*['\"]type['\"]\s*,\s*['\"]password['\"]", "(?i)input.*password|password.*input", "(?i)label|hint|title|aria", "(?i)validation|validator|schema|required"), True, needs=("password|passwd|pwd",)),
    Pattern("hardcoded-token", rf"(?:secret|token|auth[_-]?token|access[_-]?token|bearer)\s*[:=]\s*{_QUOTE}[A-Za-z0-9_\-./+=]{{8,}}{_QUOTE}", "A token is part of the code.", "Read it from the environment.", 0.8, "CWE-798", _CRYPTO, True, (*_NO_SECRET, "(?i)your[_-]?token"), True, needs=("secret|token|bearer",)),
    Pattern("hardcoded-private-key", r"-----BEGIN\s+(?:RSA\s+)?PRIVATE\s+KEY-----", "A private key is part of the code.", "Load it at run time.", 0.98, "CWE-321", _CRYPTO, needs=("-----BEGIN",)),
    Pattern("reject-unauthorized-false", r"rejectUnauthorized\s*:\s*false", "Certificates aren't verified.", "Add the certificate instead.", 0.95, "CWE-295", _CRYPTO, needs=("rejectUnauthorized",)),
    Pattern("tls-reject-env", rf"NODE_TLS_REJECT_UNAUTHORIZED\s*[=:]\s*{_QUOTE}?0{_QUOTE}?", "Certificates aren't verified in the whole process.", "Add the certificate instead.", 0.98, "CWE-295", _CRYPTO, needs=("NODE_TLS_REJECT_UNAUTHORIZED",)),
    Pattern("insecure-ssl", r"(?:verify|checkServerIdentity|secure)\s*:\s*false", "A connection isn't verified.", "Leave verification on.", 0.7, "CWE-295", _CRYPTO, needs=("verify|checkServerIdentity|secure", "false")),
)


def _no(name: str, regex: str, advice: str, needs: str | None = None) -> Pattern:
    """``needs``: the name's last word, or what is given."""
    return Pattern(name, regex, f"{name} doesn't exist.", advice, needs=(needs or name.rpartition(".")[2],))


PHANTOM = (
    _no("Array.flatDeep", r"\bArray\.flatDeep\s*\(", "flat(Infinity)"), _no("toCapitalize", r"\.toCapitalize\s*\(", "upper-case the first letter"), _no("capitalize", r"\.capitalize\s*\(\s*\)", "upper-case the first letter"),
    _no("String.prototype.contains", r"\bString\.prototype\.contains\s*[=(]", "includes"), _no("contains", rf"\.contains\s*\(\s*{_QUOTE}", "includes"), _no("flatDeep", r"\bArray\.prototype\.flatMap\s*=|\.flatDeep\s*\(", "flat or flatMap", "Array.prototype.flatMap|.flatDeep"),
    _no("isNullOrUndefined", r"\.isNullOrUndefined\s*\(", "== null"), _no("isNullOrEmpty", r"\.isNullOrEmpty\s*\(", "== null or ''"), _no("Object.values without an object", r"\bObject\.values\s*\(\s*\)\.flat\s*\(\s*\)", "give it an object", "Object.values"),
    _no("toCamelCase", r"\.toCamelCase\s*\(", "a library"), _no("toSnakeCase", r"\.toSnakeCase\s*\(", "a library"), _no("toKebabCase", r"\.toKebabCase\s*\(", "a library"),
    _no("JSON.tryParse", r"\bJSON\.tryParse\s*\(", "JSON.parse in try"), _no("JSON.safeParse", r"\bJSON\.safeParse\s*\(", "JSON.parse in try"), _no("Promise.delay", r"\bPromise\.delay\s*\(", "a promise of setTimeout"),
    _no("Promise.sleep", r"\bPromise\.sleep\s*\(", "a promise of setTimeout"), _no("Promise.wait", r"\bPromise\.wait\s*\(", "a promise of setTimeout"), _no("Promise.map", r"\bPromise\.map\s*\(", "Promise.all of a map"),
    _no("Promise.each", r"\bPromise\.each\s*\(", "a loop with await"), _no("Promise.props", r"\bPromise\.props\s*\(", "Promise.all of entries"), _no("Object.isEmpty", r"\bObject\.isEmpty\s*\(", "count the keys"),
    _no("Array.isEmpty", r"\bArray\.isEmpty\s*\(", "length === 0"), _no("trimAll", r"\.trimAll\s*\(", "replace and trim"), _no("Number.isFloat", r"\bNumber\.isFloat\s*\(", "isFinite and not isInteger"),
    _no("Math.clamp", r"\bMath\.clamp\s*\(", "min of max"), _no("Math.lerp", r"\bMath\.lerp\s*\(", "a + (b - a) * t"),
)

_COMMON_SKIP = r"/tests?/|/__tests__/|\.(?:test|spec)\.[tj]sx?$|/locales?/|/i18n/|/translations?/|/fixtures?/|/mocks?/|/__mocks__/|\.fixture\.|\.mock\.|/seeds?/|/data/static/|/e2e/|/cypress/|/playwright/"
SKIPPED_PATHS = f"(?i){_COMMON_SKIP}"
SECRET_SKIPPED_PATHS = rf"(?i){_COMMON_SKIP}|/spec/|/seed[-_]?data/|/factories/|/factory/|/fake[rs]?/|/stubs?/|\.stories\.[tj]sx?$"
COMMENT_LINE = r"^\s*(?://|\*|/\*|<!--)"
METADATA_LINE = r"(?i)^\s*(?:message|suggestion|suggestedFix|description|bad|good|owaspRef)\s*[:=]\s*['\"`]"
PATTERN_LINE = r"^\s*/.*/[gimsuy]*\s*,?\s*(?://.*)?$"
DESCRIPTION_LINE = (
    r"(?i)^\s*(?:message|description|suggestion|suggestedFix|bad|good)\s*[:=]",
    r"(?i)^\s*['\"`].*(?:does not exist|is not a|usage detected|hallucinate|phantom|plausible|method names|AI code generator|known Node\.js)",
    r"(?i)^\s*['\"`].*(?:Use\s|Replace with\s|Check\s.*documentation)",
)
#: What a comment says to suppress findings of its line, or of the next one.
IGNORE, DISABLE, NEXT = "// sift-ignore", "// sift-disable", "// sift-disable-next-line"
EXCUSES = ("// eslint-disable", "// nosec", "// nolint", "// safe:", IGNORE, DISABLE)
