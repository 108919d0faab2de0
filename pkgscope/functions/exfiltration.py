"""Counters of credential paths and suspicious hosts in a text, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of paths that only malware has a reason to read, and of hosts and domains of its payloads.
PATHS = {
    "exfil_ssh": [r"\.ssh[/\\]", r"id_rsa", r"id_ed25519", r"authorized_keys", r"known_hosts"],
    "exfil_cloud": [r"\.aws[/\\]", r"credentials", r"\.kube[/\\]", r"\.docker[/\\]config", r"\.netrc", r"gcloud"],
    "exfil_env": [r"\.env\b", r"\.pypirc", r"\.npmrc", r"\.git-credentials"],
    "exfil_browser": [
        r"Login Data", r"Cookies", r"cookies\.sqlite", r"key4\.db", r"logins\.json", r"Local State", r"AppData.*Roaming",
        r"Chrome[/\\]User Data", r"Opera Software", r"Mozilla[/\\]Firefox",
    ],
    "exfil_wallet": [r"wallet\.dat", r"Exodus", r"Electrum", r"MetaMask", r"Atomic[/\\]", r"Ethereum[/\\]keystore", r"\.bitcoin"],
    "exfil_token": [r"discord.*token", r"Telegram Desktop", r"tdata", r"[Ss]team[/\\]config", r"Minecraft"],
}
HOSTS = [
    r"discord(?:app)?\.com/api/webhooks", r"api\.telegram\.org", r"pastebin\.com", r"paste\.ee", r"hastebin", r"transfer\.sh",
    r"ngrok\.io", r"ngrok-free\.app", r"requestbin", r"webhook\.site", r"anonfiles", r"gofile\.io", r"file\.io", r"\.onion\b",
    r"burpcollaborator", r"interact\.sh", r"oast\.fun", r"dnslog",
]
DOMAINS = [r"\.tk\b", r"\.ml\b", r"\.ga\b", r"\.cf\b", r"\.gq\b", r"\.xyz\b", r"\.top\b", r"\.ru\b", r"\.su\b"]


def hits(text: Column, patterns: list[str]) -> Column:
    """Number of matches of each pattern, in either case, added up."""
    return sum((F.regexp_count(text, F.lit(f"(?i){p}")) for p in patterns), F.lit(0)).cast("long")


def counters(text: Column) -> dict[str, Column]:
    groups = {name: hits(text, patterns) for name, patterns in PATHS.items()}
    return groups | {"net_suspicious_host": hits(text, HOSTS), "net_suspicious_tld": hits(text, DOMAINS)}
