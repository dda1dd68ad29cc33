"""Text expressions: normalising, hashing, indicators, predicates and reason codes.  No UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IPV4 = r"(?<!\d)(?:\d{1,3}\.){3}\d{1,3}(?!\d)"
URL = r"(?:h(?:tt|xx)ps?|ftp|tftp|smb|file)://[A-Za-z0-9._-]+(?::\d+)?(?:/[A-Za-z0-9._~/%?&=+-]*)?"
# Architecture names and appliance words told apart by the predicates.
ARCHITECTURES = ["x86_64", "x86", "i386", "i686", "aarch64", "arm64", "arm5", "arm6", "arm7", "armv4", "armv5", "armv6", "armv7", "mipsel", "mips64", "mips", "powerpc", "ppc", "sparc", "sh4", "m68k"]
APPLIANCE_WORDS = ["sh", "shell", "enable", "system", "linuxshell", "help", "busybox"]
# Commands that show interest in the host, tools that name hosts, and tools that make file digests.
HOST_WORDS = ["uname", "hostname", "whoami", "netstat", "free", "lscpu", "w", "id"]
NETWORK_TOOLS = ["wget", "curl", "nslookup", "dig", "host", "ping", "nc", "ncat", "ssh", "scp", "sftp", "tftp", "telnet", "ftp"]
DIGEST_WORDS = ["md5sum", "shasum", "sha1sum", "sha224sum", "sha256sum", "sha384sum", "sha512sum", "certutil"]
# Top-level domains reported as rare unless the triage is given others.
RARE_TLDS = ["xyz", "top", "tk", "ml", "ga", "cf", "gq", "club", "icu", "buzz", "monster", "rest", "bar", "fit", "online", "site", "stream", "cam"]
#: Longest command text that is stored; a parameter of the normaliser.  Hashes are those of whole commands.
COMMAND_CHARS = 4000


def words(c: Column) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def tokens(c: Column) -> Column:
    """Pieces between blanks."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def _parts(c: Column, separators: str) -> Column:
    """Tokens of each part of a line, lower case; parts end at `separators`."""
    return F.transform(F.split(F.lower(c), separators), tokens)


def _followed(parts: Column, first, rest) -> Column:  # noqa: ANN001
    """Whether any part has a token that is `first` and behind it, joined by blanks, text that is `rest`."""

    def here(t: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(t))
        return (F.size(t) > 1) & F.exists(at, lambda i: first(F.element_at(t, i)) & rest(F.concat(F.array_join(F.slice(t, i + 1, F.size(t)), " "), F.lit(" "))))

    return F.exists(parts, here)


def _ends_in_word(t: Column, word: str) -> Column:
    """The token ends in `word`, which isn't part of a longer word."""
    return (t == word) | t.rlike(rf"[^a-z0-9_]{word}$")


def _uname_m(c: Column) -> Column:
    return F.contains(F.regexp_replace(F.lower(c), r"\s+", " "), F.lit("uname -m"))


def _case_word(c: Column) -> Column:
    return F.array_contains(words(c), "case")


def _c2_launch(c: Column) -> Column:
    """A token with a path, then an IPv4 literal (its dots may stand in brackets), then a port of two to five digits."""
    t = tokens(F.translate(c, "[]", ""))
    behind = lambda i: F.concat_ws(" ", F.slice(t, i + 1, 3))
    at = F.sequence(F.lit(1), F.greatest(F.size(t), F.lit(1)))
    return (F.size(t) > 1) & F.exists(at, lambda i: F.get(t, i - 1).rlike("/.") & behind(i).rlike(r"^\d{1,3}(\.\d{1,3}){3}[: ]+\d{2,5}\b"))


def _self_spread(c: Column) -> Column:
    listens = _followed(_parts(c, r"[&\n]"), lambda t: t.endswith("telnetd") | _ends_in_word(t, "nc"), lambda r: F.contains(r, F.lit("-l")))
    pushed = _followed(_parts(c, r"\n"), lambda t: _ends_in_word(t, "sh"), lambda r: r.rlike(r"^-s (telnet|ssh)\b"))
    return listens | pushed


def _host_info(c: Column) -> Column:
    listed = _followed(_parts(c, r"\n"), lambda t: _ends_in_word(t, "ls"), lambda r: F.startswith(r, F.lit("/")))
    return F.arrays_overlap(words(c), F.array(*map(F.lit, HOST_WORDS))) | F.contains(F.lower(c), F.lit("/proc/cpuinfo")) | listed


def _key_write(c: Column) -> Column:
    return F.contains(F.lower(c), F.lit("authorized_keys"))


def _immutability(c: Column) -> Column:
    by_flag = _followed(_parts(c, r"\n"), lambda t: t.endswith("chattr"), lambda r: r.rlike(r"^[+-]?ia?\b"))
    return by_flag | _followed(_parts(c, r"\n"), lambda t: _ends_in_word(t, "lockr"), lambda r: r.rlike(r"^-ia\b"))


def _directory_chain(c: Column) -> Column:
    """cd x || cd y || cd: three alternatives in a row, each a change of directory."""
    alternatives = F.transform(F.split(F.lower(c), r"\|\|"), tokens)
    n = F.size(alternatives)
    one = lambda t: (F.size(t) == 2) & (F.get(t, F.lit(0)) == "cd")

    def here(i: Column) -> Column:
        a, b, e = (F.element_at(alternatives, i + k) for k in range(3))
        opens = (F.size(a) >= 2) & F.get(a, F.size(a) - 2).endswith("cd")
        return opens & one(b) & (F.size(e) >= 2) & (F.get(e, F.lit(0)) == "cd")

    return (n >= 3) & F.exists(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: (n >= 3) & here(F.least(i, n - 2)))


def _tool_fallback(c: Column) -> Column:
    """busybox wget, or a download whose failure is followed by another command."""
    tried = F.split(F.lower(c), r"\|\|")
    downloads = F.exists(F.slice(tried, 1, F.greatest(F.size(tried) - 1, F.lit(0))), lambda x: F.element_at(F.split(x, r"\|"), -1).rlike("wget|curl"))
    return downloads | _followed(_parts(c, r"\n"), lambda t: t.endswith("busybox"), lambda r: F.startswith(r, F.lit("wget")))


PREDICATES = {
    "has_uname_m": _uname_m,
    "has_case_word": _case_word,
    "has_c2_launch": _c2_launch,
    "has_self_spread": _self_spread,
    "has_host_info": _host_info,
    "has_key_write": _key_write,
    "has_immutability": _immutability,
    "has_directory_chain": _directory_chain,
    "has_tool_fallback": _tool_fallback,
}


def normalize(c: Column, max_chars: int | None = None) -> Column:
    """Outer blanks stripped, inner runs made one space; cut at `max_chars` if given."""
    whole = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.substring(whole, 1, max_chars) if max_chars else whole


def is_cut(c: Column, max_chars: int = COMMAND_CHARS) -> Column:
    return F.length(F.trim(F.regexp_replace(c, r"\s+", " "))) > max_chars


def short_hash(c: Column, digits: int = 16) -> Column:
    return F.substring(F.sha2(c, 256), 1, digits)


def ipv4s(c: Column) -> Column:
    """IPv4 literals with octets up to 255, each once, in first-seen order."""
    return F.array_distinct(F.filter(F.regexp_extract_all(c, F.lit(f"({IPV4})")), lambda x: F.forall(F.split(x, r"\."), lambda o: o.cast("int") <= 255)))


def urls(c: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(f"({URL})")), lambda x: F.regexp_replace(x, r"[.,;:]+$", "")))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"://([^/:]+)", 1))


def is_ipv4(c: Column) -> Column:
    return c.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")


def domains(c: Column) -> Column:
    """Hosts of URLs that are names, lower case."""
    return F.array_distinct(F.filter(F.transform(urls(c), url_host), lambda h: F.contains(h, F.lit(".")) & ~is_ipv4(h)))


def hashes(c: Column) -> Column:
    """File digests of 32, 40 or 64 hex digits: named as such, or any where a tool that makes digests runs in the line."""
    digits = r"[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32}"
    low = F.lower(c)
    named = F.regexp_extract_all(low, F.lit(rf"(?:sha256|sha1|md5)[:=]({digits})(?![0-9a-f])"), 1)
    flat = F.array_join(tokens(low), " ")
    tool = F.arrays_overlap(words(c), F.array(*map(F.lit, DIGEST_WORDS))) | F.contains(flat, F.lit("openssl dgst")) | F.contains(flat, F.lit("gpg --print-md"))
    bare = F.regexp_extract_all(low, F.lit(rf"\b({digits})\b"), 1)
    return F.array_distinct(F.concat(named, F.when(tool, bare).otherwise(F.array().cast("array<string>"))))


def paths(c: Column) -> Column:
    """Absolute paths of three characters or more at the start of a word of the shell."""
    return F.array_distinct(F.filter(F.regexp_extract_all(c, F.lit(r"(?:^|[\s|;&`(])(/[A-Za-z0-9._/+-]+)"), 1), lambda p: F.length(p) >= 3))


def base64_run(c: Column) -> Column:
    """Length of the longest run of base64 characters (40 or more) that has upper and lower case letters and digits; 0 if none."""
    mixed = F.filter(F.split(c, r"[^A-Za-z0-9+/=]+"), lambda r: (F.length(r) >= 40) & r.rlike("[A-Z]") & r.rlike("[a-z]") & r.rlike("[0-9]"))
    return F.coalesce(F.array_max(F.transform(mixed, F.length)), F.lit(0))


def rare_domain(c: Column, tlds: list[str] = RARE_TLDS) -> Column:
    """A host with a rare top-level domain: behind ://, or behind a network tool in the same command."""
    ends = F.array(*map(F.lit, tlds))

    def tld_in(text: Column) -> Column:
        return F.arrays_overlap(F.regexp_extract_all(text, F.lit(r"(?<![a-z0-9-])[a-z0-9-]+(?:\.[a-z0-9-]+)*\.([a-z]{2,24})\b"), 1), ends)

    low = F.lower(c)
    after_scheme = F.exists(F.slice(F.split(low, "://"), 2, F.size(F.split(low, "://"))), lambda r: F.array_contains(ends, F.regexp_extract(r, r"^[a-z0-9-]+(?:\.[a-z0-9-]+)*\.([a-z]{2,24})\b", 1)))
    commands = F.split(low, r"[|;&\n]")
    tools = "|".join(NETWORK_TOOLS)
    after_tool = F.exists(commands, lambda s: tld_in(F.regexp_extract(s, rf"\b(?:{tools})\b(.*)$", 1)))
    return after_scheme | after_tool


def predicate(c: Column, name: str) -> Column:
    return F.coalesce(PREDICATES[name](c), F.lit(False))


def appliance_word(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin(APPLIANCE_WORDS), F.lit(False))


def architectures(c: Column) -> Column:
    """Sorted architecture names that occur as whole words."""
    low = F.lower(c)
    return F.array_sort(F.array_compact(F.array(*[F.when(low.rlike(rf"\b{a}\b"), F.lit(a)) for a in ARCHITECTURES])))


def most_restrictive(c: Column) -> Column:
    """Aggregate of public / confidential / null: any confidential wins, all public is public, else null."""
    return F.when(F.count_if(c == "confidential") > 0, "confidential").when((F.count(F.lit(1)) > 0) & (F.count_if(c == "public") == F.count(F.lit(1))), "public")


def stickier(old: Column, new: Column) -> Column:
    return (
        F.when((F.coalesce(old, F.lit("")) == "confidential") | (F.coalesce(new, F.lit("")) == "confidential"), "confidential")
        .when((old == "public") & (new == "public"), "public")
        .otherwise(F.coalesce(new, old))
    )
