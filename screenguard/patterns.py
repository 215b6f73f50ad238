"""Regular expressions and word lists that results depend on. Fixed values."""

from __future__ import annotations

# Detectors by kind, in the order in which kinds are reported (fixed values).
# All are searched for anywhere in the text; (?i) ones ignore case.
DETECTORS = {
    "HexPrivateKey": r"(?i)\b(?:0x)?[0-9a-f]{64}\b",
    "Wif": r"\b[5KL][1-9A-HJ-NP-Za-km-z]{50,51}\b",
    "ExtendedKey": r"\b(?:xprv|xpub|ypub|zpub|tprv|tpub)[1-9A-HJ-NP-Za-km-z]{107,108}\b",
    "SolanaKey": r"\b[1-9A-HJ-NP-Za-km-z]{64,88}\b",
    "AwsAccessKey": r"(?i)\b(?:AKIA|ASIA)[A-Z0-9]{15,17}\b",
    "GithubToken": r"(?i)\bgh[poursr]_[A-Za-z0-9]{34,38}\b",
    "StripeKey": r"(?i)\b(?:sk|rk)_live_[A-Za-z0-9]{20,99}\b",
    "LlmApiKey": r"(?i)\bsk-(?:proj-[A-Za-z0-9_\-]{80,200}|ant-[A-Za-z0-9_\-]{80,200}|[A-Za-z0-9]{40,60})\b",
    "SlackToken": r"(?i)\bxox[bpaors]-[A-Za-z0-9\-]{20,}\b",
    "TwilioSid": r"(?i)\bAC[a-f0-9]{30,34}\b",
    "JsonWebToken": r"\beyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\b",
    "EnvLineValue": r"(?i)\b(?:export\s+)?[A-Z][A-Z0-9_]{1,40}\s*=\s*[A-Za-z0-9_\-./:]{15,}",
    "HighEntropyToken": r"[A-Za-z0-9_\-]{30,}",
}
KINDS = ("SeedPhrase", *DETECTORS)
# Labels by kind (fixed values).
LABELS = {
    "SeedPhrase": "SEED PHRASE",
    "HexPrivateKey": "PRIVATE KEY",
    "Wif": "WIF KEY",
    "ExtendedKey": "XPRIV/XPUB",
    "SolanaKey": "SOL KEY",
    "AwsAccessKey": "AWS KEY",
    "GithubToken": "GITHUB TOKEN",
    "StripeKey": "STRIPE KEY",
    "LlmApiKey": "API KEY",
    "SlackToken": "SLACK TOKEN",
    "TwilioSid": "TWILIO SID",
    "JsonWebToken": "JWT",
    "EnvLineValue": "ENV",
    "HighEntropyToken": "TOKEN",
}
# Words in a row that make a seed phrase, and bytes of the longest word (fixed values).
SEED_RUN, LONGEST_WORD = 8, 8

# Payloads of QR codes: addresses, payment links, the shape of a seed phrase and its word counts (fixed values).
QR_ADDRESSES = (
    r"^0x[a-fA-F0-9]{40}$",
    r"^0x[a-fA-F0-9]{64}$",
    r"^(?:EQ|UQ|Ef|Uf|kQ|kf|0Q|0f)[A-Za-z0-9_\-]{46}$",
    r"^T[1-9A-HJ-NP-Za-km-z]{33}$",
    r"^(?:bc1[a-z0-9]{38,62}|[13][1-9A-HJ-NP-Za-km-z]{25,34})$",
    r"^[1-9A-HJ-NP-Za-km-z]{32,44}$",
)
QR_PAYMENT = r"^(?:bitcoin|ethereum|tron|ton|solana|web3|ethereum_uri):"
QR_SEED = r"^(?:[a-z]+\s+){11,23}[a-z]+$"
QR_SEED_WORDS = (12, 15, 18, 21, 24)

# Windows: substrings of lower-case titles and process names (fixed values).
WALLETS = ("phantom", "metamask", "trust wallet", "trustwallet", "tonkeeper", "rabby", "rainbow", "coinbase wallet", "backpack", "solflare", "exodus", "wasabi", "electrum", "ledger live", "trezor suite")
EDITORS = ("notepad.exe", "notepad++.exe", "code.exe", "rider64.exe", "idea64.exe", "pycharm64.exe", "sublime_text.exe", "subl.exe", "atom.exe", "vim.exe", "nvim.exe")
TITLE_HINTS = (".env", "secrets", "credentials", "private", ".pem", ".key", "id_rsa", "id_ed25519", "wallet.dat", "keystore", "mnemonic", "seed.txt")
TERMINALS = ("windowsterminal.exe", "wt.exe", "powershell.exe", "pwsh.exe", "cmd.exe", "conhost.exe", "alacritty.exe", "wezterm-gui.exe")

# Object classes by number (fixed values).
CLASSES = ("wallet_receive_popup", "seed_phrase_reveal", "private_key_reveal", "env_file_editor", "credential_terminal", "portfolio_balance")


def java(pattern: str) -> str:
    """The pattern for Java: Unicode word borders, spaces and case, and the end of text as only end."""
    flags, body = ("(?iuU)", pattern[4:]) if pattern.startswith("(?i)") else ("(?U)", pattern)
    return flags + (body[:-1] + r"\z" if body.endswith("$") else body)
