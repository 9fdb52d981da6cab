"""The rules of line scanning. Java regular expressions get the (?U) prefix, so classes are Unicode as in Python."""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    detector: str
    pattern: str
    severity: str
    description: str
    fix_suggestion: str
    cwe: str | None = None
    #: Pieces of text of which every match of the pattern holds one, with the same letters; none: not known.
    needs: tuple[str, ...] = ()


# Rule patterns and texts, in the order in which detectors and rules run.
RULES = (
    # secrets: reconstructed, since the original list is not published
    Rule("secrets", r"""\bsk-[a-zA-Z0-9]{20,}""", "BLOCK", "Possible OpenAI API key", "Load the key from an environment variable or a secret store", "CWE-798", needs=("sk-",)),
    Rule("secrets", r"""\bghp_[a-zA-Z0-9]{36}\b""", "BLOCK", "GitHub personal access token", "Load the token from an environment variable or a secret store", "CWE-798", needs=("ghp_",)),
    Rule("secrets", r"""(?i)aws_secret_access_key\s*=\s*["'][^"']+["']""", "BLOCK", "AWS secret access key exposed", "Load the key from an environment variable or a secret store", "CWE-798", needs=("=",)),
    Rule("secrets", r"""(?i)(password|passwd|pwd)\s*=\s*["'][^"']{4,}["']""", "BLOCK", "Hardcoded password — use environment variable", "Load the password from an environment variable or a secret store", "CWE-798", needs=("=",)),
    Rule("secrets", r"""AKIA[0-9A-Z]{16}""", "BLOCK", "AWS access key ID exposed", "Load the key from an environment variable or a secret store", "CWE-798", needs=("AKIA",)),
    Rule("secrets", r"""(?i)(secret|token|api[_-]?key)\s*=\s*["'][^"']{8,}["']""", "BLOCK", "Hardcoded secret, token or API key", "Load the secret from an environment variable or a secret store", "CWE-798", needs=("=",)),
    Rule("injection", r"""\beval\s*\(""", "WARN", "eval() can execute arbitrary code with untrusted input", "Use ast.literal_eval() for safe literal evaluation", needs=("eval",)),
    Rule("injection", r"""\bexec\s*\(""", "WARN", "exec() can execute arbitrary code with untrusted input", "Avoid dynamic code execution; refactor to explicit logic", needs=("exec",)),
    Rule("injection", r"""\bos\.system\s*\(""", "WARN", "os.system() executes shell commands and is a command-injection risk", "Use subprocess.run(['cmd', 'arg'], check=True) with a list", needs=("os.system",)),
    Rule("injection", r"""\bsubprocess\.(call|run|Popen)\s*\([^)]*shell\s*=\s*True""", "WARN", "shell=True in subprocess is a command-injection risk", "Pass arguments as a list: subprocess.run(['cmd', 'arg'])", needs=("subprocess.",)),
    Rule("injection", r"""\.execute\s*\(\s*f["']""", "BLOCK", "SQL injection: f-string used in cursor.execute()", "Use parameterized queries: cursor.execute(query, (param,))", needs=(".execute",)),
    Rule("injection", r"""\.execute\s*\(.*\.format\s*\(""", "BLOCK", "SQL injection: .format() used to build SQL query", "Use parameterized queries: cursor.execute(query, (param,))", needs=(".execute",)),
    Rule("injection", r"""\.execute\s*\(["'][^"']*["'\s]*\+""", "BLOCK", "SQL injection: string concatenation used to build SQL query", "Use parameterized queries: cursor.execute(query, (param,))", needs=(".execute",)),
    Rule("crypto", r"""\bhashlib\.md5\s*\(""", "WARN", "MD5 is cryptographically weak for security-sensitive contexts", "Use hashlib.sha256() or better; for passwords use bcrypt/argon2", needs=("hashlib.md5",)),
    Rule("crypto", r"""\bhashlib\.sha1\s*\(""", "WARN", "SHA-1 is cryptographically weak", "Use hashlib.sha256() or better; for passwords use bcrypt/argon2", needs=("hashlib.sha1",)),
    Rule("crypto", r"""\brandom\.(random|randint|choice|shuffle|sample)\s*\(""", "INFO", "random module is not cryptographically secure", "Use the secrets module for security-sensitive randomness", needs=("random.",)),
    Rule("crypto", r"""\bDES\b.*\.new\s*\(|\bfrom\s+Crypto\.Cipher\s+import\s+DES\b""", "WARN", "DES is a deprecated and broken cipher", "Use AES-256-GCM or ChaCha20-Poly1305", needs=("DES",)),
    Rule("crypto", r"""\bRC4\b|\bRC2\b|\bARC4\b""", "WARN", "RC4/RC2 are broken stream ciphers", "Use AES-256-GCM or ChaCha20-Poly1305", needs=("RC4", "RC2",)),
    Rule("crypto", r"""\bECB\b|MODE_ECB""", "WARN", "ECB mode leaks plaintext patterns and is not semantically secure", "Use AES-GCM (authenticated) or AES-CBC with a random IV", needs=("ECB",)),
    Rule("env_vars", r"""\bprint\s*\(.*os\.environ""", "WARN", "Environment variable exposed via print()", "Never print env vars — they may contain secrets", needs=("os.environ",)),
    Rule("env_vars", r"""\blogging\.\w+\s*\(.*os\.environ""", "WARN", "Environment variable written to logs", "Log a safe placeholder; never log raw env values", needs=("os.environ",)),
    Rule("env_vars", r"""\breturn\s+.*os\.environ\[""", "WARN", "Environment variable returned directly from function", "Validate and sanitize env values before returning to callers", needs=("os.environ",)),
    Rule("env_vars", r"""\bjson\.dumps\s*\(.*os\.environ""", "WARN", "Environment variables serialized to JSON", "Only expose specific, non-sensitive config values", needs=("os.environ",)),
    Rule("env_vars", r"""\bresponse\b.*os\.environ|os\.environ.*\bresponse\b""", "WARN", "Environment variable may be included in HTTP response", "Never expose raw env vars in API responses", needs=("os.environ",)),
    Rule("dependencies", r"""\bimport\s+pickle\b|from\s+pickle\s+import""", "WARN", "pickle deserialization is unsafe with untrusted data", "Use json or a schema-validated format (e.g. pydantic) instead", needs=("pickle",)),
    Rule("dependencies", r"""\byaml\.load\s*\([^,)]+\)(?!\s*,\s*Loader)""", "BLOCK", "yaml.load() without Loader= is arbitrary code execution", "Use yaml.safe_load() or yaml.load(f, Loader=yaml.SafeLoader)", needs=("yaml.load",)),
    Rule("dependencies", r"""\bimport\s+marshal\b|from\s+marshal\s+import""", "WARN", "marshal is not safe for untrusted data", "Use json or protobuf for external data serialization", needs=("marshal",)),
    Rule("dependencies", r"""\bimport\s+shelve\b|from\s+shelve\s+import""", "INFO", "shelve uses pickle internally — unsafe with untrusted data", "Use a proper database (SQLite, Redis) for external data", needs=("shelve",)),
    Rule("dependencies", r"""\b__import__\s*\(""", "WARN", "__import__() with dynamic strings is a code injection risk", "Use importlib.import_module() with a validated module name", needs=("__import__",)),
    Rule("git_safety", r"""^\s*except\s*:\s*$""", "WARN", "Broad exception suppression", "Catch specific exceptions (e.g., except ValueError:) to avoid hiding bugs", needs=("except",)),
    Rule("git_safety", r"""^\s*except\s+(Exception|BaseException)\s*:\s*$""", "WARN", "Overly broad exception catch", "Catch specific exceptions; if you must catch Exception, at least log it", needs=("except",)),
    Rule("git_safety", r"""^\s*except\s+(Exception|BaseException)\s+as\s+\w+\s*:\s*$""", "INFO", "Catching Exception as variable — ensure it is logged", "Log or re-raise the exception rather than silently suppressing it", needs=("except",)),
    Rule("git_safety", r"""^\s*except.*:\s*pass\s*$""", "WARN", "Silent exception swallow (pass)", "Log the exception or re-raise instead of silently ignoring it", needs=("except",)),
    Rule("git_safety", r"""\bpdb\.set_trace\(\)""", "WARN", "Debugger breakpoint left in code", "Remove pdb.set_trace() before committing", needs=("pdb.set_trace()",)),
    Rule("git_safety", r"""\bbreakpoint\(\)""", "WARN", "Built-in breakpoint() left in code", "Remove breakpoint() before committing", needs=("breakpoint()",)),
    Rule("git_safety", r"""["']C:\\\\Users\\\\""", "INFO", "Hardcoded Windows user path", "Use pathlib or environment variables instead of absolute user paths", needs=("C:",)),
    Rule("git_safety", r"""["']\/home\/\w+\/""", "INFO", "Hardcoded Unix home path", "Use Path.home() or environment variables instead of absolute home paths", needs=("/home/",)),
)
DETECTORS = ("secrets", "injection", "crypto", "env_vars", "dependencies", "git_safety")


def load_rules(text: str, fix: str = "") -> tuple[Rule, ...]:
    """Rules of a JSON file: {"rules": [{detector, severity, pattern, description, and perhaps fix_suggestion and cwe}]}."""
    import json

    return tuple(Rule(r["detector"], r["pattern"], r["severity"], r["description"], r.get("fix_suggestion", fix), r.get("cwe")) for r in json.loads(text)["rules"])


def as_table(spark, rules: tuple[Rule, ...] = RULES):
    """The rules as rows, numbered as findings number them."""
    return spark.createDataFrame([(k, *r[:6]) for k, r in enumerate(rules)], "rule int, detector string, pattern string, severity string, description string, fix_suggestion string, cwe string")
