"""The expressions as SQL functions; Catalyst inlines them, so they cost what the columns cost."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..patterns import DETECTORS, EDITORS, KINDS, LABELS, LONGEST_WORD, QR_ADDRESSES, QR_PAYMENT, QR_SEED, QR_SEED_WORDS, SEED_RUN, TERMINALS, TITLE_HINTS, WALLETS, java
from ..words import words as word_list
from .hashing import BASIS, PRIME_LOW


def _q(text: str) -> str:
    return "r'" + text + "'" if "'" not in text else '"' + text.replace("\\", "\\\\") + '"'


def register(spark: SparkSession, words: tuple[str, ...] | None = None) -> list[str]:
    """Create temporary functions scan_secrets, qr_kind, window_verdict, kind_label, bbox_iou and fnv1a64; returns their names."""
    words = words or word_list(spark)
    others = ", ".join(
        f"if({'t rlike ' + _q(java(p)) if k != 'HighEntropyToken' else 'exists(regexp_extract_all(t, ' + _q(p) + ', 0), s -> s rlike ' + _q('[0-9]') + ' and s rlike ' + _q('[A-Za-z]') + ' and size(array_distinct(split(s, ' + chr(39) * 2 + '))) >= 8)'}{' and not contains(t, ' + chr(39) + ' ' + chr(39) + ')' if k == 'SolanaKey' else ''}, '{k}', null)"
        for k, p in DETECTORS.items()
    )
    listed = ", ".join(f"'{w}'" for w in words)
    seed = f"contains(array_join(transform(filter(split(t, r'\\P{{IsAlphabetic}}+'), w -> w <> ''), w -> if(octet_length(lower(w)) <= {LONGEST_WORD} and lower(w) in ({listed}), '1', '0')), ''), '{'1' * SEED_RUN}')"
    any_of = lambda col, parts: "(" + " or ".join(f"contains({col}, '{p}')" for p in parts) + ")"
    bare = "regexp_replace(p, r'(?U)^\\s+|\\s+\\z', '')"
    address = " or ".join(f"{bare} rlike {_q(java(a))}" for a in QR_ADDRESSES)
    made = {
        "scan_secrets": f"(t string) returns array<string> return case when t is null then cast(array() as array<string>) when {seed} then array('{KINDS[0]}') else array_compact(array({others})) end",
        "qr_kind": f"(p string) returns string return case when {address} then 'Address' when {bare} rlike {_q(java(QR_PAYMENT))} then 'PaymentUri' when {bare} rlike {_q(java(QR_SEED))} and size(split({bare}, r'(?U)\\s+')) in {QR_SEED_WORDS} then 'SeedPhrase' else 'Unknown' end",
        "window_verdict": f"(t string, p string) returns string return case when {any_of('lower(p)', WALLETS)} or {any_of('lower(t)', WALLETS)} then 'CryptoWallet' when {any_of('lower(p)', EDITORS)} and {any_of('lower(t)', TITLE_HINTS)} then 'SecretsEditor' when {any_of('lower(p)', TERMINALS)} then 'Terminal' else 'NotSensitive' end",
        "kind_label": "(k string) returns string return case " + " ".join(f"when k = '{k}' then '{v}'" for k, v in LABELS.items()) + " end",
        "bbox_iou": "(ax bigint, ay bigint, aw bigint, ah bigint, bx bigint, by bigint, bw bigint, bh bigint) returns float return case when least(ax + aw, bx + bw) <= greatest(ax, bx) or least(ay + ah, by + bh) <= greatest(ay, by) then float(0) else float(float((least(ax + aw, bx + bw) - greatest(ax, bx)) * (least(ay + ah, by + bh) - greatest(ay, by))) / (float(aw * ah) + float(bw * bh) - float((least(ax + aw, bx + bw) - greatest(ax, bx)) * (least(ay + ah, by + bh) - greatest(ay, by))))) end",
    }
    digits, byte = "hex(cast(t as binary))", "cast(conv(substring(hex(cast(t as binary)), 2 * i + 1, 2), 16, 10) as bigint)"
    low = f"((a.lo ^ {byte}) * {PRIME_LOW})"
    step = f"(a, i) -> named_struct('hi', (a.hi * {PRIME_LOW} + shiftright({low}, 32) + shiftleft((a.lo ^ {byte}) & {0xFFFFFF}L, 8)) & {0xFFFFFFFF}L, 'lo', {low} & {0xFFFFFFFF}L)"
    made["fnv1a64"] = f"(t string) returns string return aggregate(if(length({digits}) > 0, sequence(0, cast(length({digits}) / 2 - 1 as int)), cast(array() as array<int>)), named_struct('hi', {BASIS >> 32}L, 'lo', {BASIS & 0xFFFFFFFF}L), {step}, a -> lower(concat(lpad(hex(a.hi), 8, '0'), lpad(hex(a.lo), 8, '0'))))"
    for name, body in made.items():
        spark.sql(f"create or replace temporary function {name}{body}")
    return list(made)
