"""Packs of line patterns over numbered source lines."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.literals import candidates, count, matches, once
from siltstone.operators.grams import lines_with


@dataclass(frozen=True)
class Pack:
    """Patterns in order, and how many hits stay: a file and pattern, a pattern, in total a repo."""

    name: str
    patterns: tuple[tuple[str, str], ...]
    per_file: int
    per_pattern: int
    budget: int
    case: str = "smart"
    ranker: str = "generic"
    #: Patterns that are looked for in some files only: the pattern's name and a pattern of paths.
    files: tuple[tuple[str, str], ...] = ()
    #: Whether the budget goes by score instead of by pattern.
    by_score: bool = False

    def regexes(self) -> list[tuple[str, str]]:
        return [(i, flagged(p, self.case)) for i, p in self.patterns]


def flagged(pattern: str, case: str) -> str:
    """Smart case ignores case unless the pattern has an upper-case letter of its own."""
    loose = case == "ignore" or (case == "smart" and not re.search("[A-Z]", re.sub(r"\\.", "", pattern)))
    return ("(?i)" + pattern) if loose else pattern


#: Pattern, weight; matched on the path or the text of a hit.
RANKERS = {
    "none": (),
    "generic": (("text", r"^import\s", -20), ("path", r"(?i)/test/", -10), ("path", r"(?i)\.spec\.|_test\.|test_", -10)),
    "payment": (
        ("path", r"/services/", 40), ("path", r"/services/(chase|firstdata|braintree|paypal|venmo)/", 60), ("path", r"/com/lyft/|/me/lyft/", 20),
        ("text", r"FIRST_DATA_URL|ClientTokenizeCard|ChaseNetKeyApi|EncryptionListener|onEncryptionComplete|ProtectPANandCVV|PayPalClient|BraintreeClient|approvalUrl|redirectUri", 20),
        ("text", r"^import\s", -20), ("path", r"/apktool_out/|\.smali$", -15), ("path", r"/(androidx|org/chromium|io/sentry|com/google|kotlin|j\$)/", -25), ("path", r"events/client|Companion|R\.java", -30),
    ),
    "systems": (("text", r"(System\.loadLibrary|JNIEXPORT|external fun|native\s+)", 40), ("path", r"\.(c|cc|cpp|h|hpp|m|mm|rs)$", 25), ("text", r"(?i)parser|decode|inflate|unmarshal|deserialize", 20), ("text", r"^import\s", -20), ("path", r"(?i)/test/", -15)),
}

#: Boundaries of mobile, native and web code, and registrations of routes by framework.
BOUNDARIES = (
    ("android-component", r"Activity|Service|BroadcastReceiver|ContentProvider|onCreate\(|onReceive\("),
    ("webview", r"WebView|addJavascriptInterface|evaluateJavascript|setJavaScriptEnabled|loadUrl\("),
    ("network", r"Retrofit|OkHttpClient|HttpURLConnection|new URL\(|@GET|@POST|fetch\("),
    ("payment-auth", r"TokenizeCard|FIRST_DATA_URL|ChaseNetKeyApi|BraintreeClient|PayPal|Venmo|redirectUri|approvalUrl"),
    ("native", r"System\.loadLibrary|JNIEXPORT|native\s+|external fun"),
    ("parser", r"ObjectInputStream|readObject\(|Parcelable|Serializable|JsonAdapter|ProtoAdapter|ZipInputStream"),
    ("rails-controller", r"class\s+\w+Controller\s*<|before_action|skip_before_action|protect_from_forgery|params\["),
)
ROUTES = (
    ("express-route", r"""\b(app|router|r|fastify|server)\.(get|post|put|delete|patch|all|use)\s*\(\s*["'`]"""),
    ("nest-decorator", r"@(Get|Post|Put|Delete|Patch|All|Controller)\s*\("),
    ("flask-django-route", r"""@\w+\.route\s*\(|\b(path|re_path|url)\s*\(\s*["'r]"""),
    ("fastapi-route", r"@(app|router|api)\.(get|post|put|delete|patch|websocket)\s*\("),
    ("spring-mapping", r"@(RequestMapping|GetMapping|PostMapping|PutMapping|DeleteMapping|PatchMapping)\s*\("),
    ("go-http-route", r"\b(http|mux|r|router|e)\.(HandleFunc|Handle|GET|POST|PUT|DELETE|PATCH)\s*\("),
    ("rails-routes", r"""\b(get|post|put|patch|delete|resources?|match)\s+["':]"""),
    ("aspnet-route", r"\[(HttpGet|HttpPost|HttpPut|HttpDelete|HttpPatch|Route)\s*[\](]"),
)

_DOCKER, _YAML, _COMPOSE, _TF = r"(^|/)Dockerfile[^/]*$", r"\.ya?ml$", r"(^|/)docker-compose[^/]*$", r"\.tf$"

#: The packs' patterns.
PACKS = {
    "crypto": Pack("crypto", (
        ("nonct-memcmp", r"\b(memcmp|strcmp|strncmp)\s*\("),
        ("nonct-secret-compare", r"(==|!=|\.equals\(|\.compare\().{0,50}(hmac|\bmac\b|signature|\bsig\b|token|secret|password|passwd|digest|auth.?tag|api.?key|csrf)|(hmac|\bmac\b|signature|\bsig\b|token|secret|password|passwd|digest|auth.?tag|api.?key|csrf).{0,50}(==|!=|\.equals\(|\.compare\()"),
        ("elidable-zero", r"memset\s*\([^,]*(key|secret|password|passwd|seed|mnemonic|priv|token)[^,]*,\s*0"),
        ("secret-lifetime", r"\b(private_?key|secret_?key|master_?key|mnemonic|seed_?phrase|passphrase)\b"),
        ("weak-crypto-rng", r"(Math\.random|\brand\s*\(|\bsrand\s*\(|random\.random\(|mt_rand|new Random\().{0,60}(token|secret|\bkey\b|nonce|\biv\b|salt|password|otp|session)|(token|secret|\bkey\b|nonce|\biv\b|salt|password|otp|session).{0,60}(Math\.random|\brand\s*\(|\bsrand\s*\(|random\.random\(|mt_rand|new Random\()"),
    ), 4, 6, 30, "ignore"),
    "sharp_edges": Pack("sharp_edges", (
        ("alg-confusion", r"""alg['"]?\s*[:=]\s*['"]?none|algorithms?\s*[:=].*HS256|verify\([^)]*algorithms?\s*=|jwt\.decode\([^)]*verify\s*=\s*False|MD5|DES|RC4|ECB|md5\(|new MessageDigest"""),
        ("dangerous-default", r"""verify\s*=\s*False|InsecureSkipVerify\s*[:=]\s*true|rejectUnauthorized\s*[:=]\s*false|CURLOPT_SSL_VERIFY(PEER|HOST)\s*,\s*0|check_hostname\s*=\s*False|trustAllCerts|ALLOW_ALL_HOSTNAME"""),
        ("config-cliff", r"""csrf\w*\s*[:=]\s*(false|off|disabled)|debug\s*[:=]\s*True|Access-Control-Allow-Origin['"]?\s*[:,]\s*['"]\*|cors\([^)]*origin\s*[:=]\s*['"]?\*|secure\s*[:=]\s*false|httpOnly\s*[:=]\s*false"""),
        ("silent-failure", r"""except\s*:\s*pass|catch\s*\([^)]*\)\s*\{\s*\}|rescue\s*=>\s*\w+\s*$|_ = err|err\s*!=\s*nil\s*\{\s*\}|on_error\s*[:=]\s*['"]?(ignore|continue)"""),
        ("stringly-typed", r"""role\s*==\s*['"]admin['"]|permission\s*==\s*['"]|hasRole\(['"]|authorize\(['"][^'"]+['"]\)|if\s+user\.role\s*===?\s*['"]"""),
    ), 4, 6, 30),
    "authz": Pack("authz", (
        ("endpoint", r"@app\.(route|get|post|put|delete|patch)|@(Get|Post|Put|Delete|Patch|Request)Mapping|app\.(get|post|put|delete|patch)\(|router\.(get|post|put|delete|patch)\(|@router\.(get|post|put|delete|patch)|def\s+\w+\(self,\s*request"),
        ("object-by-id", r"(findById|findOne|get_object_or_404|find_by_id|getById|\.find\(|objects\.get\(|Repository\.findById)\s*\([^)]*(params|req\.(params|query|body)|request\.|\bid\b)"),
    ), 8, 12, 30),
    "systems": Pack("systems", (
        ("native-load", r"System\.loadLibrary|JNIEXPORT|external fun|native\s+"),
        ("unsafe-memory", r"Unsafe|ByteBuffer\.allocateDirect|memcpy|strcpy|strcat|sprintf|gets\(|alloca\("),
        ("archive-parser", r"ZipInputStream|GZIPInputStream|Inflater|ByteArrayInputStream|TarInputStream"),
        ("deserialize", r"ObjectInputStream|readObject\(|Marshal\.load|pickle\.loads?|yaml\.load\b|unserialize\("),
        ("process-exec", r"Runtime\.exec|ProcessBuilder|exec\(|execve|popen\(|system\("),
    ), 3, 6, 60, "smart", "systems"),
    "logic": Pack("logic", (
        ("money-arithmetic", r"\b(balance|amount|price|total|credit|debit|refund|quantity|qty|stock)\b"),
        ("state-transition", r"""\b(status|state|phase|stage)\s*[:=]\s*["']?(pending|approved|completed|paid|shipped|active|closed|verified)"""),
        ("transaction-boundary", r"\b(begin_?transaction|beginTransaction|commit|rollback|\.transaction\(|with_?lock|acquire_?lock|mutex|atomic)\b"),
        ("ownership-check", r"\b(owner_?id|user_?id|account_?id|tenant_?id)\b.{0,40}(==|!=|===|\.equals|===)"),
        ("check-then-act", r"\bif\s*\(.{0,60}(exists|is_?valid|has_?|can_?|already)\b"),
        ("idempotency-replay", r"\b(nonce|idempotenc|request_?id|dedup|replay|once|consumed)\b"),
    ), 3, 3, 16, "ignore"),
    "entry_points": Pack("entry_points", BOUNDARIES + ROUTES, 5, 20, 80, "smart", "payment", by_score=True),
    "route_patterns": Pack("route_patterns", ROUTES, 5, 20, 160),
    "iac": Pack("iac", (
        ("container-privileged", r"privileged:\s*true|--privileged|hostPID:\s*true|hostNetwork:\s*true|hostIPC:\s*true|allowPrivilegeEscalation:\s*true"),
        ("container-root", r"^USER\s+root|^USER\s+0\b"),
        ("image-unpinned", r"FROM\s+[^\s]+:latest|image:\s*[^\s]+:latest|FROM\s+[^@\s:]+\s*$"),
        ("secret-in-config", r"""(password|passwd|secret|api[_-]?key|access[_-]?key|token|private[_-]?key)\s*[:=]\s*['"][^'"$\{][^'"]{3,}"""),
        ("network-exposed", r"""0\.0\.0\.0/0|cidr_blocks\s*=\s*\[\s*['"]0\.0\.0\.0/0|::/0|publiclyAccessible\s*=\s*true|0\.0\.0\.0:"""),
        ("storage-public", r"""acl\s*=\s*['"]public-read|block_public_(acls|policy)\s*=\s*false|force_destroy\s*=\s*true"""),
        ("tls-disabled", r"insecure\s*=\s*true|skip_tls_verify\s*=\s*true|sslmode=disable|encrypt(ion|ed)?\s*=\s*false"),
    ), 4, 6, 30, "ignore", files=(
        ("container-privileged", f"{_YAML}|{_DOCKER}|{_COMPOSE}"), ("container-root", _DOCKER), ("image-unpinned", f"{_DOCKER}|{_YAML}"), ("secret-in-config", rf"{_DOCKER}|{_YAML}|{_TF}|\.tfvars$|\.env$"),
        ("network-exposed", f"{_TF}|{_YAML}|{_COMPOSE}"), ("storage-public", _TF), ("tls-disabled", f"{_TF}|{_YAML}"),
    )),
}

#: Obligations of native and of managed code; the first match of a line counts.
NATIVE_RULES = (
    ("fixed-size-buffer", r"\b[A-Za-z_]\w*\s+\**\w+\s*\[\s*[A-Za-z_][\w]*\s*\]"),
    ("raw-copy", r"\b(memcpy|memmove|memset|strcpy|strncpy|strcat|strncat|sprintf|snprintf|vsprintf|alloca|gets|scanf|read|recv)\s*\("),
    ("alloc-arith", r"\b(malloc|calloc|realloc|zmalloc|zrealloc|xmalloc|kmalloc)\s*\([^;]*[*+][^;]*\)"),
    ("int-overflow-size", r"(?i)(?:\[[^\]\n]*[\w)]\s*(?:<<|\*)\s*[(\w][^\]\n]*\])|(?:\b\w*(?:len|size|count|sep|off|idx|index|nbytes|nmemb|width|height|cap)\w*\b[^;\n]*?[-+]\s*\w+\s*\*\s*[(\w])"),
    ("gc-rooting", r"\b(luaS_new\w*|luaH_new\w*|luaC_\w+|luaM_\w*(?:new|malloc|realloc)\w*|incr_top|setsvalue|sethvalue|setobj|gc_\w+|lua_(?:newtable|createtable|newuserdata\w*|pushstring|pushlstring|pushfstring|pushvfstring|pushcclosure|concat|checkstack|call|pcall|getfield|setfield|gettable|settable|rawset|next|error)\b)"),
    ("lifetime-free", r"\b(free|kfree|vfree|g_free|xfree|delete|Py_DECREF|Py_XDECREF|RefCount|release|destroy)\b\s*[(.]|->\s*reset\("),
)
WEB_RULES = (
    ("command-exec", r"\b(exec|execSync|spawn|spawnSync|execFile|execFileSync|fork)\s*\(|\b(os\.system|subprocess\.(run|call|Popen|check_output|check_call)|commands\.getoutput)\s*\(|\b(shell_exec|passthru|proc_open|popen|system)\s*\(|Runtime\.getRuntime\(\)\.exec|ProcessBuilder\s*\("),
    ("deserialization", r"\b(pickle|cPickle)\.loads?\s*\(|\byaml\.(unsafe_)?load\s*\(|\bmarshal\.loads?\s*\(|\bMarshal\.load\s*\(|\bunserialize\s*\(|ObjectInputStream|\.readObject\s*\(|node-serialize|yaml\.load\s*\([^)]*$"),
    ("dynamic-eval", r"""\beval\s*\(|\bnew\s+Function\s*\(|\bFunction\s*\(\s*["'`]|\bvm\.runIn\w+\s*\(|\bexec\s*\(\s*["'`]|\bcompile\s*\(.*['"]exec['"]"""),
    ("sql-sink", r"\.(query|execute|executemany|exec|raw|prepare|annotate|extra)\s*\(|cursor\(\)\.execute|sequelize\.query|knex\.raw|\bdb\.run\s*\(|createQuery\s*\(|@Query\s*\("),
    ("path-fs", r"\b(readFile|readFileSync|writeFile|writeFileSync|createReadStream|createWriteStream|sendFile|send_file|fopen|file_get_contents|file_put_contents|readlink|unlink|fs\.open)\s*\(|new\s+File\s*\(|Paths\.get\s*\("),
    ("ssrf", r"\b(requests\.(get|post|put|delete|head|request)|urllib\.(request\.)?urlopen|urlopen|http\.(get|request)|https\.(get|request)|fetch|axios\.(get|post|put|request)|got|superagent|HttpClient|openConnection|curl_exec)\s*\("),
    ("template-xss", r"dangerouslySetInnerHTML|\.innerHTML\s*=|insertAdjacentHTML|\bv-html\b|\|\s*safe\b|html_safe|mark_safe|render_template_string|\.html\s*\(|document\.write\s*\(|@Html\.Raw|Markup\s*\("),
    ("object-authz", r"\b(findById|find_by_id|getById|findByPk|findOne|get_object_or_404)\s*\(|objects\.get\s*\(|\.get\s*\(\s*(?:id|pk)\s*=|WHERE\s+id\s*="),
    ("authz-decision", r"\b(user_id|userId|owner_id|ownerId|tenant_id|tenantId|account_id|accountId)\b\s*(===?|!==?)|\b(hasRole|hasPermission|isAuthorized|checkAccess|requireRole|ensureOwner|authorize|can)\s*\(|@(login_required|requires_auth|roles_required|PreAuthorize|RolesAllowed)"),
    ("open-redirect", r"""\b(res\.redirect|response\.redirect|sendRedirect|HttpResponseRedirect|redirect)\s*\(|header\s*\(\s*["']Location"""),
)
NATIVE_FILES, BOTH_FILES, WEB_FILES = r"\.(c|cc|cpp|cxx|h|hpp|m|mm)$", r"\.(rs|go)$", r"\.(js|jsx|ts|tsx|mjs|cjs|py|rb|php|java|cs|kt|scala|php5|phtml)$"
COMMENT = r"^\s*(//|#|\*|/\*)"


def rank(path: Column, text: Column, ranker: str) -> Column:
    out = F.lit(0)
    for side, pattern, weight in RANKERS[ranker]:
        out = out + F.when((path if side == "path" else text).rlike(pattern), weight).otherwise(0)
    return out


def pattern_scan(lines: DataFrame, pack: Pack, ranker: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """``repo, pattern, path, line, score, place``: a pack's hits within its limits; ``ranker`` may score path and text its own way.

    Every pattern is a literal of one projection, so it is compiled once and a line
    is read once; it is tried only on lines that hold one of its required literals.  The limits are ranks: by line in a file, by score in a pattern,
    by pattern in a repo, in which a pattern gets what those before it have left.
    """
    only = dict(pack.files)
    here = lambda i, p: matches(p) & F.col("path").rlike(only[i]) if i in only else matches(p)
    found = F.array_compact(F.array(*[F.when(here(i, p), F.struct(F.lit(o).alias("ord"), F.lit(i).alias("pattern"))) for o, (i, p) in enumerate(pack.regexes())]))
    lines = once(candidates(lines, [p for _, p in pack.regexes()]), "found", found)
    hits = lines.select("repo", "path", "line", (ranker or (lambda p, t: rank(p, t, pack.ranker)))(F.col("path"), F.col("text")).alias("score"), F.explode("found").alias("h")).select("repo", "path", "line", "score", "h.ord", "h.pattern")
    in_file = Window.partitionBy("repo", "ord", "path").orderBy("line")
    in_pattern = Window.partitionBy("repo", "ord").orderBy(F.desc("score"), "path", "line")
    few = hits.withColumn("n", F.row_number().over(in_file)).filter(F.col("n") <= pack.per_file)
    few = few.withColumn("m", F.row_number().over(in_pattern)).filter(F.col("m") <= pack.per_pattern)
    budget = [F.desc("score"), "ord", "m"] if pack.by_score else ["ord", "m"]
    placed = few.withColumn("place", F.row_number().over(Window.partitionBy("repo").orderBy(*budget)))
    return placed.filter(F.col("place") <= pack.budget).select("repo", "pattern", "path", "line", "score", "place")


def obligations(lines: DataFrame) -> DataFrame:
    """``repo, path, line, kind``: what a line obliges to check, by its file's rules; blanks, comments and lines over 400 characters don't."""

    def first(rules) -> Column:
        out = F.lit(None).cast("string")
        for kind, pattern in reversed(rules):
            out = F.when(matches(pattern), F.lit(kind)).otherwise(out)
        return out

    p = F.col("path")
    kind = F.when(p.rlike(NATIVE_FILES), first(NATIVE_RULES)).when(p.rlike(BOTH_FILES), first(NATIVE_RULES + WEB_RULES)).when(p.rlike(WEB_FILES), first(WEB_RULES))
    # candidates come first: a filter before them would make the lines' columns once more for each use
    rows = candidates(lines, [x for _, x in NATIVE_RULES + WEB_RULES]).filter((F.trim("text") != "") & (F.length("text") <= 400) & ~F.col("text").rlike(COMMENT))
    return once(rows, "kind", kind).select("repo", "path", "line", "kind").filter("kind is not null")


def telemetry(lines: DataFrame) -> DataFrame:
    """One row a fuzzing run of its log lines: last counters, new and reduced inputs, crashes, and what they advise.

    ``corpus`` and ``crashers`` come from the last such line of engines that count them,
    ``artifact`` and ``summary`` from the first line that names one; ``ended_with`` is
    done if the last status line says so, crash with a summary or a crasher, else unknown.
    """
    lines = once(lines, "text", F.col("text"))  # many patterns read it
    number = lambda name: F.nullif(F.regexp_extract("text", name + r":\s*(\d+)", 1), F.lit("")).try_cast("bigint")
    execs = F.nullif(F.regexp_extract("text", r"^#(\d+)", 1), F.lit("")).try_cast("bigint")
    last = lambda c, name: F.max_by(c, F.when(c.isNotNull(), F.col("line"))).alias(name)
    early = lambda c, name: F.min_by(c, F.when(c.isNotNull(), F.col("line"))).alias(name)
    some = lambda pattern, i=1: F.nullif(F.regexp_extract("text", pattern, i), F.lit(""))
    status = some(r"(?i)^#\d+\s+(NEW|REDUCE|pulse|INITED|DONE)\b.*?\bcov:\s*\d+.*?\bft:\s*\d+")
    go = r"(?i)\bcorpus:\s*(\d+).*?\bcrashers?:\s*(\d+)"
    agg = lines.groupBy("run_id").agg(
        last(execs, "execs"), last(number("cov"), "cov"), last(number("ft"), "features"), last(number("exec/s"), "execs_per_second"),
        F.count_if(F.col("text").rlike(r"^#\d+\s+NEW")).alias("new_inputs"), F.count_if(F.col("text").rlike(r"^#\d+\s+REDUCE")).alias("reduced"),
        F.count_if(F.col("text").rlike("ERROR: .*Sanitizer|deadly signal")).alias("crashes"), F.bool_or(F.col("text").rlike("^Done ")).alias("done"),
        last(some(go, 1).try_cast("bigint"), "corpus"), last(some(go, 2).try_cast("bigint"), "crashers"), early(some(r"(?i)Test unit written to (\S+)"), "artifact"),
        early(F.trim(some(r"(?i)SUMMARY:\s*(?:libFuzzer|AddressSanitizer|UndefinedBehaviorSanitizer):\s*(.+)")), "summary"), last(F.upper(status), "_last"),
    )
    ended = F.when(F.col("summary").isNotNull() | (F.coalesce("crashers", F.lit(0)) > 0), "crash").when(F.col("_last") == "DONE", "done").otherwise("unknown")
    signal = F.when(F.col("crashes") > 0, "crashed").when(F.col("cov").isNull(), "no-coverage-data").when(F.col("new_inputs") == 0, "saturating").when(F.col("done"), "completed").otherwise("interrupted")
    return agg.withColumn("signal", signal).withColumn("ended_with", ended).drop("_last")


#: Where untrusted input enters, and what is dangerous to do with it.
SOURCES = r"@(app|router)\.(get|post|put|delete|patch|use)|@(Get|Post|Put|Delete|Patch|Request)Mapping|\b(app|router|fastify)\.(get|post|put|delete|patch|use)\s*\(|\w+Command\s*\(|exports\.handler|def\s+\w+\(\s*(self,\s*)?request|func\s+\w+\(\w+\s+http\.|req\.(body|query|params|headers|cookies)|request\.(GET|POST|args|form|json|data)|process\.argv|os\.Args|getParameter|getInputStream|System\.in"
SINKS = r"\b(system|popen|execve?|execl[ep]?|spawnSync|spawn|fork|Runtime|ProcessBuilder|eval)\s*\(|os\.system|subprocess\.|child_process|new Function|vm\.runIn|pickle\.loads?|yaml\.(load|unsafe_load)|marshal\.loads|ObjectInputStream|readObject|XMLDecoder|unserialize|deserialize|\.(query|execute|raw|exec)\s*\(|executeQuery|createStatement|prepareStatement|innerHTML|dangerouslySetInnerHTML|document\.write|sendFile|sendfile|readFileSync|readFile|createReadStream|fopen|memcpy|memmove|strcpy|strcat|sprintf|\bgets\s*\(|alloca"
#: Definitions of entry points.
ENTRY_DEFS = r"\w+Command\s*\(|@app\.(route|get|post|put|delete|patch)|@(Get|Post|Put|Delete|Patch|Request)Mapping|app\.(get|post|put|delete|patch|use)\s*\(|router\.(get|post|put|delete|patch)\s*\(|exports\.handler|def\s+\w+\(\s*request|func\s+\w+\(\s*\w+\s+http\.|int\s+main\s*\(|fastify\.(get|post)"
#: What tells the kind of a program.
PROGRAM = (
    ("web", r"@(?:Get|Post|Put|Delete|Patch|Request)Mapping|@app\.route\b|@router\.(?:get|post|put|delete)\b|\bhttp\.ListenAndServe\b|\b(?:flask|fastapi|express\(\)|django|spring\.web|gin\.(?:Default|New))\b"),
    ("main", r"""\bint\s+main\s*\(|\bfunc\s+main\s*\(|\bfn\s+main\s*\(|def\s+main\s*\(|__name__\s*==\s*["']__main__["']|public\s+static\s+void\s+main"""),
    ("socket", r"\b(?:listen|accept|epoll_create\w*|kqueue|WSAStartup)\s*\(|net\.Listen|ServerSocket|tokio::net|asyncio\.start_server|http\.ListenAndServe"),
    ("argv", r"\bchar\s*\*\*?\s*argv\b|\bint\s+argc\b|\bos\.Args\b|process\.argv|std::env::args|\bsys\.argv\b|\bgetopt\w*\s*\("),
)
#: Signatures of fuzz harnesses by engine, the first engine of a file counts.
HARNESSES = (
    ("libfuzzer", r"LLVMFuzzerTestOneInput"),
    ("cargo-fuzz", r"fuzz_target!\s*\("),
    ("go-fuzz", r"func\s+Fuzz\w*\s*\(\s*\w+\s+\*testing\.F"),
    ("jazzer", r"fuzzerTestOneInput|FuzzedDataProvider|@FuzzTest"),
    ("node-property", r"""@jazzer\.js/core|require\(['"]@jazzer"""),
)
#: Build files, and their hardening flags.
BUILD_FILES = r"(^|/)(Makefile|makefile|GNUmakefile|CMakeLists\.txt|Cargo\.toml|configure\.ac|configure|meson\.build|BUILD|BUILD\.bazel)$|\.(gradle|pro|cmake|mk|bazel|bzl)$"
HARDENING = (
    ("stack_protector", r"-fstack-protector|[/\\]GS\b"),
    ("pie", r"-fPIE\b|-fpie\b|-pie\b"),
    ("relro", r"-z\s+relro|-z\s+now|-Wl,-z,relro|-Wl,-z,now"),
    ("fortify", r"-D_FORTIFY_SOURCE"),
    ("cfg", r"[/\\]guard:cf\b"),
    ("no_exec_stack", r"-z\s+noexecstack|-Wl,-z,noexecstack"),
)
#: Sources and sinks by language of the file, as names of members and calls.
TAINT_SOURCES = (
    ("javascript", r"\.(js|jsx|mjs|cjs)$", r"\b(req|request|ctx)\.(body|query|params|cookies|headers|url|originalUrl)\b|\w\.\w+\.(body|query|params|cookies|headers)\b|\bprocess\.(argv|env)\b"),
    ("typescript", r"\.(ts|tsx)$", r"\b(req|request|ctx)\.(body|query|params|cookies|headers|url|originalUrl)\b|\w\.\w+\.(body|query|params|cookies|headers)\b"),
    ("python", r"\.py$", r"\b(request|self)\.(args|form|json|values|cookies|headers|data|files|GET|POST)\b|\bos\.(getenv|environ)\b"),
    ("go", r"\.go$", r"\b(r|req|c)\.(URL|Header|Body|Form|PostForm|Cookies)\b|\bos\.Getenv\b"),
    ("ruby", r"\.(rb|erb)$", r"\b(params|request|ENV)\b"),
    ("java", r"\.java$", r"\brequest\.(getParameter|getQueryString|getHeader|getCookies)\s*\("),
)
TAINT_SINKS = (
    ("javascript", r"\.(js|jsx|mjs|cjs)$", r"\b(eval|Function|exec|execSync|spawn|spawnSync|fetch|require)\s*\(|\b(child_process|cp|vm)\.(exec|execSync|spawn|spawnSync|runInContext|runInNewContext|runInThisContext|compileFunction)\s*\(|\b(fs|fsp|fsPromises)\.(readFile|writeFile|appendFile|unlink|createReadStream|createWriteStream|open)\s*\(|\w\.(query|exec|raw|execute|run)\s*\(|\.(innerHTML|outerHTML)\s*=|\b(res|response)\.(send|render|redirect)\s*\("),
    ("typescript", r"\.(ts|tsx)$", r"\b(eval|Function|exec|execSync|spawn|spawnSync|fetch|require)\s*\(|\b(child_process|cp|vm)\.(exec|execSync|spawn|spawnSync|runInContext|runInNewContext)\s*\(|\b(fs|fsp|fsPromises)\.(readFile|writeFile|appendFile|unlink|createReadStream|createWriteStream|open)\s*\(|\w\.(query|exec|raw|execute|run)\s*\(|\.(innerHTML|outerHTML)\s*="),
    ("python", r"\.py$", r"\b(eval|exec|compile)\s*\(|\bos\.(system|popen)\s*\(|\bsubprocess\.(run|call|check_call|check_output|Popen)\s*\(|\b(pickle|joblib|torch)\.loads?\s*\("),
    ("go", r"\.go$", r"\bexec\.(Command|CommandContext)\s*\(|\bos\.(Open|Create|Remove|ReadFile|WriteFile)\s*\("),
    ("ruby", r"\.(rb|erb)$", r"\b(eval|system|exec|popen|send)\b"),
    ("java", r"\.java$", r"\b(Runtime|ProcessBuilder)\.\w+\s*\("),
)


def _first(table, value: Column) -> Column:
    """The name of the first pattern of the table that the value matches, else null."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(table):
        out = F.when(value.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def anchors(lines: DataFrame, pattern: str, per_file: int = 8, width: int = 160) -> DataFrame:
    """``repo, path, line, signal``: the first lines of each file that match, without their indent, clipped."""
    pattern = flagged(pattern, "smart")
    hits = candidates(lines, [pattern]).filter(F.col("text").rlike(pattern)).groupBy("repo", "path", "line").agg(F.min("text").alias("text"))
    few = hits.withColumn("n", F.row_number().over(Window.partitionBy("repo", "path").orderBy("line"))).filter(F.col("n") <= per_file)
    return few.select("repo", "path", "line", F.substring(F.trim("text"), 1, width).alias("signal"))


def entry_defs(lines: DataFrame) -> DataFrame:
    """``repo, path, n``: how many lines of a file define an entry point."""
    return candidates(lines, [ENTRY_DEFS]).filter(F.col("text").rlike(ENTRY_DEFS)).groupBy("repo", "path").agg(F.count("*").alias("n"))


def any_fixed(lines: DataFrame, signals, most: int = 80) -> DataFrame:
    """``repo, path``: the first files by path that hold any of the fixed strings of three characters or more, of which 120 count."""
    wanted = lines.sparkSession.createDataFrame([(x,) for x in [x for x in signals if len(x) >= 3][:120]], "signal string")
    files = lines_with(lines, wanted).select("repo", "path").distinct()
    return files.withColumn("n", F.row_number().over(Window.partitionBy("repo").orderBy("path"))).filter(F.col("n") <= most).drop("n")


def program_kind(lines: DataFrame) -> DataFrame:
    """``repo, web, main, socket, argv, kind, confidence`` by the number of matches of each family."""
    rows = once(lines.select("repo", "text"), "text", F.col("text"))
    rows = once(rows, "low", F.lower("text"))
    n = rows.groupBy("repo").agg(*[F.sum(count(p, "text", "low")).cast("long").alias(i) for i, p in PROGRAM])
    rules = [(F.col("web") >= 2, "web-service", F.lit("high")), ((F.col("main") > 0) & (F.col("socket") > 0), "daemon", F.when(F.col("socket") >= 2, "high").otherwise("medium")), ((F.col("main") > 0) & (F.col("argv") > 0), "cli", F.lit("medium")), (F.col("main") == 0, "library", F.lit("medium"))]
    kind, sure = F.lit("unknown"), F.lit("low")
    for when, name, how in reversed(rules):
        kind, sure = F.when(when, name).otherwise(kind), F.when(when, how).otherwise(sure)
    return n.withColumn("kind", kind).withColumn("confidence", sure)


def harnesses(lines: DataFrame) -> DataFrame:
    """``repo, path, engine, line, confidence``: fuzz harnesses, by the first engine in order that a file has."""
    engine = F.array_compact(F.array(*[F.when(matches(p), F.struct(F.lit(o).alias("ord"), F.lit(i).alias("engine"))) for o, (i, p) in enumerate(HARNESSES)]))
    first = once(candidates(lines, [p for _, p in HARNESSES]), "found", engine).select("repo", "path", "line", F.explode("found").alias("e")).groupBy("repo", "path").agg(F.min(F.struct("e.ord", "line", "e.engine")).alias("m"))
    built = lines.groupBy("repo").agg(F.bool_or(F.col("path").rlike(r"(^|/)build\.sh$")).alias("built"))
    sure = F.when(F.col("built") | (F.col("m.engine") == "cargo-fuzz"), "high").otherwise("medium")
    return first.join(built, "repo").select("repo", "path", "m.engine", "m.line", sure.alias("confidence"))


def hardening(lines: DataFrame) -> DataFrame:
    """One row a repo: its number of build files and, a flag, the first of them that sets it, else null."""
    build = lines.filter(F.col("path").rlike(BUILD_FILES))
    first = [F.min(F.when(F.col("text").rlike(p), F.col("path"))).alias(i) for i, p in HARDENING]
    return build.groupBy("repo").agg(F.countDistinct("path").alias("build_files"), *first)


def taint_names(lines: DataFrame, table, per_file: int = 200) -> DataFrame:
    """``repo, path, line, language``: lines that name a source or sink of their file's language, the first of each file."""
    language = _first([(i, files) for i, files, _ in table], F.col("path"))
    here = F.lit(False)
    for _, files, names in table:
        here = here | (F.col("path").rlike(files) & matches(names))
    hits = candidates(lines, [names for _, _, names in table]).filter(here).select("repo", "path", "line", language.alias("language"))
    return hits.withColumn("n", F.row_number().over(Window.partitionBy("repo", "path").orderBy("line"))).filter(F.col("n") <= per_file).drop("n")


def logic_candidates(lines: DataFrame, invariants: DataFrame, budget: int = 16) -> DataFrame:
    """``repo, place, kind, id``: invariants first, on up to half the budget, and probes of the logic pack on the rest."""
    few = invariants.withColumn("place", F.row_number().over(Window.partitionBy("repo").orderBy("ord", "id"))).filter(F.col("place") <= -(-budget // 2))
    held = few.groupBy("repo").agg(F.max("place").alias("held"))
    probes = pattern_scan(lines, PACKS["logic"]).join(held, "repo", "left").withColumn("place", F.col("place") + F.coalesce("held", F.lit(0))).filter(F.col("place") <= budget)
    return few.select("repo", "place", F.lit("invariant").alias("kind"), "id").union(probes.select("repo", "place", F.lit("probe").alias("kind"), F.concat_ws(":", "pattern", "path", F.col("line").cast("string"))))
