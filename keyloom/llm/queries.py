"""The corpus operators' queries over the driver's tables, and their SQL where SQL can say it."""

from __future__ import annotations

from . import decontaminate, htmltext, langid, licenses, mixing, mtree, secrets, simhash, toxicity, urlfilter


def queries() -> dict:
    return {
        "op1_secrets": secrets.op1_secrets,
        "op2_license_scan": licenses.op2_license_scan,
        "op3_url_filter": urlfilter.op3_url_filter,
        "op4_mtree_topk": mtree.op4_mtree_topk,
        "op6_html_text": htmltext.op6_html_text,
        "op5_simhash_near_dedup": simhash.op5_simhash,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_decontaminate": decontaminate.op8_decontaminate,
        "op9_mixing": mixing.op9_mixing,
        "op10_language": langid.op10_language,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_license_scan": licenses.OP2_SQL,
        "op3_url_filter": urlfilter.OP3_SQL,
        "op4_mtree_topk": mtree.OP4_SQL,
        "op9_mixing": mixing.OP9_SQL,
    }
