"""The subpackage's registered queries and, where SQL can express them, their SQL."""

from . import chat, exact, media, mixing, packing, sharding, simhash, suffix, toxicity, warc

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_chat_format": chat.op2_chat_format,
    "op3_media": media.op3_media,
    "op4_packing": packing.op4_packing,
    "op5_warc": warc.op5_warc,
    "op6_sharding": sharding.op6_sharding,
    "op7_suffix": suffix.op7_suffix,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_simhash": simhash.op9_simhash,
    "op10_exact_dedup": exact.op10_exact_dedup,
}

ORACLE = {
    "op1_mixing": mixing.SQL,
    "op2_chat_format": chat.SQL,
    "op5_warc": warc.SQL,
    "op6_sharding": sharding.SQL,
    "op10_exact_dedup": exact.SQL,
}
