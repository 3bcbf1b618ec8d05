"""The threat rule table and the literals each rule needs.

A rule is (pattern, score). Order matters: it decides which rule comes first in
reports and which category wins a tie.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

try:  # the parser module moved in Python 3.11
    from re import _constants as sre
    from re import _parser as sre_parse
except ImportError:  # pragma: no cover
    import sre_constants as sre
    import sre_parse

# Rule patterns and scores per category, in evaluation order.
RULE_TABLE: dict[str, tuple[tuple[str, float], ...]] = {
    "defacement": (
        (r"(?i)(hacked|h4ck3d|haxed)\s+by\s+\w+", 0.95),
        (r"(?i)(owned|0wn3d|pwned|pwn3d)\s+by\s+\w+", 0.95),
        (r"(?i)(defaced|d3f4c3d)\s+by\s+\w+", 0.98),
        (r"(?i)was\s+here", 0.85),
        (r"(?i)you\s+have\s+been\s+(hacked|pwned)", 0.90),
        (r"(?i)(anonymous|4n0nym0us)", 0.75),
        (r"(?i)we\s+are\s+legion", 0.85),
        (r"(?i)expect\s+us", 0.85),
        (r"(?i)lulzsec", 0.90),
        (r"(?i)lizard\s+squad", 0.90),
        (r"(?i)team\s+\w+\s+was\s+here", 0.85),
        (r"(?i)cyber\s+(team|army|warriors?)", 0.80),
        (r"(?i)free\s+(palestine|gaza|kashmir|tibet)", 0.70),
        (r"(?i)stop\s+(the\s+)?(war|genocide|killing)", 0.65),
        (r"(?i)(government|corporate)\s+corruption", 0.60),
        (r"(?i)wake\s+up\s+(people|world|sheeple)", 0.65),
        (r"(?i)your\s+security\s+(sucks|is\s+shit)", 0.75),
        (r"(?i)patch\s+your\s+(shit|systems?)", 0.70),
        (r"(?i)learn\s+to\s+code", 0.60),
        (r"(?i)script\s+kiddie", 0.55),
        (r"(?i)(security\s+)?breach(ed)?", 0.70),
        (r"(?i)compromised", 0.70),
        (r"(?i)infiltrated", 0.65),
        (r"(?i)vandalized", 0.75),
        (r"(?i)hijacked", 0.75),
        (r"(?i)taken\s+over", 0.70),
        (r"(?i)rooted", 0.80),
    ),
    "cryptojacking": (
        (r"(?i)coinhive\.min\.js", 0.95),
        (r"(?i)cryptoloot\.(pro|com)", 0.95),
        (r"(?i)(web)?miner\.js", 0.90),
        (r"(?i)coinminer\.js", 0.95),
        (r"(?i)webminepool\.(tk|com)", 0.90),
        (r"(?i)browsermine\.com", 0.90),
        (r"(?i)jsecoin\.com", 0.85),
        (r"(?i)crypto-loot\.com", 0.90),
        (r"(?i)stratum\+tcp://", 0.85),
        (r"(?i)(pool|mine)\.supportxmr\.com", 0.90),
        (r"(?i)xmrpool\.(eu|net)", 0.90),
        (r"(?i)minexmr\.com", 0.90),
        (r"(?i)nanopool\.org", 0.85),
        (r"(?i)new\s+CoinHive\.(User|Anonymous)", 0.95),
        (r"(?i)\.startMining\s*\(", 0.85),
        (r"(?i)throttle\s*:\s*0\.\d+", 0.70),
        (r"(?i)threads\s*:\s*\d+", 0.65),
        (r"(?i)autoThreads\s*:\s*true", 0.70),
        (r"(?i)monero\s*(wallet|address)", 0.80),
        (r"4[0-9AB][0-9a-zA-Z]{93}", 0.75),
        (r"(?i)\.moneroocean\.stream", 0.90),
    ),
    "sql_injection": (
        (r"(?i)(\s|%20)+(or|and)(\s|%20)+('|\")?\s*=\s*('|\")?", 0.85),
        (r"(?i)(\s|%20)+(or|and)(\s|%20)+1\s*=\s*1", 0.90),
        (r"(?i)union(\s|%20)+select", 0.90),
        (r"(?i)union(\s|%20)+all(\s|%20)+select", 0.92),
        (r"(?i)drop(\s|%20)+(table|database)", 0.95),
        (r"(?i)insert(\s|%20)+into", 0.80),
        (r"(?i)update(\s|%20)+\w+(\s|%20)+set", 0.80),
        (r"(?i)delete(\s|%20)+from", 0.85),
        (r"(?i)exec(\s|%20)*\(", 0.85),
        (r"(?i)execute(\s|%20)+immediate", 0.85),
        (r"(?i)xp_cmdshell", 0.95),
        (r"(?i)sp_executesql", 0.90),
        (r"(?i)waitfor(\s|%20)+delay", 0.85),
        (r"(?i)benchmark\s*\(", 0.80),
        (r"--(\s|%20)*$", 0.70),
        (r"/\*.*\*/", 0.65),
        (r";\s*(drop|delete|update|insert)", 0.85),
        (r"(?i)char\s*\(\s*\d+(\s*,\s*\d+)*\s*\)", 0.75),
        (r"(?i)(ascii|substring)\s*\(", 0.70),
        (r"(?i)hex\s*\(", 0.65),
    ),
    "xss": (
        (r"<script[^>]*>", 0.85),
        (r"</script>", 0.85),
        (r"(?i)javascript\s*:", 0.80),
        (r"(?i)vbscript\s*:", 0.85),
        (r"(?i)on(load|error|click|mouse\w+|key\w+)\s*=", 0.75),
        (r"(?i)on(focus|blur|change|submit)\s*=", 0.75),
        (r"<iframe[^>]*>", 0.80),
        (r"<object[^>]*>", 0.75),
        (r"<embed[^>]*>", 0.75),
        (r"<img[^>]*src[^>]*=", 0.60),
        (r"<svg[^>]*onload[^>]*=", 0.85),
        (r"&#x[0-9a-fA-F]+;", 0.70),
        (r"&#\d+;", 0.65),
        (r"%3Cscript", 0.80),
        (r"%3C%73%63%72%69%70%74", 0.85),
        (r"(?i)document\.(write|writeln)\s*\(", 0.70),
        (r"(?i)eval\s*\(", 0.85),
        (r"(?i)innerHTML\s*=", 0.65),
        (r"(?i)outerHTML\s*=", 0.70),
        (r"(?i)\.appendChild\s*\(", 0.60),
    ),
    "backdoor": (
        (r"(?i)eval\s*\(\s*\$_(GET|POST|REQUEST|COOKIE)", 0.95),
        (r"(?i)(system|exec|shell_exec|passthru)\s*\(\s*\$_(GET|POST|REQUEST)", 0.95),
        (r"(?i)assert\s*\(\s*\$_(GET|POST|REQUEST)", 0.90),
        (r"(?i)preg_replace\s*\(.*/e", 0.85),
        (r"(?i)create_function\s*\(", 0.85),
        (r"(?i)(filesman|filestools)", 0.90),
        (r"(?i)c99\s*shell", 0.95),
        (r"(?i)r57\s*shell", 0.95),
        (r"(?i)b374k", 0.90),
        (r"(?i)wso\s*shell", 0.90),
        (r"(?i)weevely", 0.85),
        (r"(?i)alfa\s*shell", 0.90),
        (r"(?i)base64_decode\s*\(", 0.75),
        (r"(?i)str_rot13\s*\(", 0.80),
        (r"(?i)gzinflate\s*\(", 0.80),
        (r"(?i)gzuncompress\s*\(", 0.75),
        (r"(?i)hex2bin\s*\(", 0.70),
        (r"(?i)move_uploaded_file", 0.70),
        (r"(?i)file_put_contents\s*\(", 0.65),
        (r"(?i)fwrite\s*\(", 0.60),
        (r"(?i)fputs\s*\(", 0.60),
        (r"(?i)curl_exec\s*\(", 0.65),
        (r"(?i)file_get_contents\s*\([\"']https?://", 0.60),
        (r"(?i)include\s*\([\"']https?://", 0.85),
        (r"(?i)require\s*\([\"']https?://", 0.85),
    ),
    "phishing": (
        (r"(?i)<form[^>]*action\s*=\s*[\"'][^\"']*\.(tk|ml|ga|cf)", 0.80),
        (r"(?i)please\s+verify\s+your\s+(account|password|identity)", 0.75),
        (r"(?i)(suspended|locked)\s+(account|access)", 0.70),
        (r"(?i)click\s+here\s+(immediately|now|to\s+verify)", 0.65),
        (r"(?i)urgent\s+(action|security|update)\s+required", 0.70),
        (r"(?i)update\s+your\s+(payment|billing|credit\s+card)", 0.75),
        (r"(?i)confirm\s+your\s+(identity|account|password)", 0.70),
        (r"(?i)(security|safety)\s+alert", 0.60),
        (r"(?i)unusual\s+activity", 0.65),
        (r"(?i)(paypal|pp)\s*[.-]\s*(verify|update|confirm)", 0.80),
        (r"(?i)amazon\s*[.-]\s*(security|verify|update)", 0.80),
        (r"(?i)microsoft\s*[.-]\s*account", 0.75),
        (r"(?i)apple\s*[.-]\s*id", 0.75),
        (r"(?i)(facebook|fb)\s*[.-]\s*security", 0.75),
        (r"(?i)(secure|account|verify)[.-]\w+\.(tk|ml|ga|cf)", 0.75),
    ),
    "malware": (
        (r"<iframe[^>]*style\s*=\s*[\"'][^\"']*display\s*:\s*none", 0.85),
        (r"<iframe[^>]*width\s*=\s*[\"']0[\"']", 0.80),
        (r"<iframe[^>]*height\s*=\s*[\"']0[\"']", 0.80),
        (r"<iframe[^>]*frameborder\s*=\s*[\"']0[\"'][^>]*width\s*=\s*[\"']0", 0.85),
        (r"(?i)window\.location\s*=\s*[\"'][^\"']*\.(tk|ml|ga|cf)", 0.75),
        (r"(?i)meta\s+http-equiv\s*=\s*[\"']refresh[\"'][^>]*url=", 0.60),
        (r"(?i)document\.location\.href\s*=", 0.65),
        (r"(?i)window\.open\s*\([\"']https?://[^\"']*\.(tk|ml|ga)", 0.70),
        (r"String\.fromCharCode\s*\((\s*\d+\s*,?)+\)", 0.70),
        (r"unescape\s*\(\s*[\"']%[0-9a-fA-F]+", 0.65),
        (r"document\.write\s*\(\s*unescape", 0.80),
        (r"atob\s*\([\"'][A-Za-z0-9+/=]+[\"']\)", 0.65),
        (r"(?i)(malware|virus|trojan|worm)\.(com|net|org|exe)", 0.95),
        (r"(?i)download\.(exe|scr|bat|cmd|com|pif)", 0.80),
        (r"(?i)\.exe\?[a-z0-9]+=[a-z0-9]+", 0.75),
    ),
    "benign": (
        (r"(?i)under\s+maintenance", -0.3),
        (r"(?i)scheduled\s+downtime", -0.3),
        (r"(?i)we['']ll\s+be\s+back\s+soon", -0.2),
        (r"(?i)updating\s+our\s+(website|site|system)", -0.2),
        (r"(?i)new\s+features?\s+coming", -0.1),
        (r"(?i)copyright\s+©?\s*20\d{2}", -0.1),
        (r"(?i)privacy\s+policy", -0.1),
        (r"(?i)terms\s+of\s+service", -0.1),
        (r"(?i)cookie\s+policy", -0.1),
    ),
}

# Words whose mere presence in the main content is suspicious.
SUSPICIOUS_KEYWORDS = (
    "hacked", "owned", "pwned", "defaced", "unauthorized",
    "breached", "compromised", "attacked", "vandalized", "hijacked",
)

THREAT_CATEGORIES = tuple(c for c in RULE_TABLE if c != "benign")


@dataclass(frozen=True)
class Rule:
    """One row of the rule table; ``index`` counts from 1 over all rules."""

    index: int
    category: str
    rule_no: int
    pattern: str
    score: float

    @property
    def label(self) -> str:
        if self.category == "benign":
            return f"benign_indicator: {self.pattern}"
        return f"{self.category}: {self.pattern}"


def build_rules(table=RULE_TABLE) -> tuple[Rule, ...]:
    rows = [(c, n, p, s) for c, rules in table.items() for n, (p, s) in enumerate(rules, 1)]
    return tuple(Rule(i, *row) for i, row in enumerate(rows, 1))


RULES = build_rules()


def required_literals(pattern: str) -> tuple[tuple[str, ...], ...]:
    """Sets of lower-case texts; every match contains one text of every set.

    Only sets worth testing are kept: words of three letters or more, and
    marks such as ``=`` or ``(``. Plain substring tests on these are far
    cheaper than the pattern itself.
    """
    sets = _needs(sre_parse.parse(pattern))
    useful = {tuple(sorted(s)) for s in sets if all(len(x) > 2 or not x.isalnum() for x in s) and not any(x.isspace() for x in s)}
    return tuple(sorted(useful, key=lambda s: (-min(map(len, s)), len(s), s)))


def _needs(sequence) -> list[frozenset[str]]:
    """Sets of alternatives of which a match of the sequence needs one each."""
    found: list[frozenset[str]] = []
    run = ""
    for op, arg in list(sequence) + [(None, None)]:
        if op is sre.LITERAL:
            run += chr(arg).lower()
            continue
        if run:
            found.append(frozenset([run]))
            run = ""
        if op is sre.SUBPATTERN:
            found += _needs(arg[-1])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
            found += _needs(arg[2])
        elif op is sre.BRANCH:
            branches = [_longest(_needs(b)) for b in arg[1]]
            if all(branches):
                found.append(frozenset().union(*branches))
    return found


def _longest(sets: list[frozenset[str]]) -> frozenset[str] | None:
    return max(sets, key=lambda s: (min(map(len, s)), -len(s)), default=None)


def python_matches(pattern: str, text: str) -> int:
    """Number of matches by the plain regular expression module (for tests)."""
    return sum(1 for _ in re.finditer(pattern, text))
