"""SQL for the training-data queries that SQL can express on whole tables."""

_SPACE = r"\t-\r\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_TOKENS = rf"len(regexp_extract_all(content, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{_SPACE}]'))"

ORACLES = {
    "p1_found": f"""
        SELECT DISTINCT 'document' AS item_type, id AS item_id FROM scan_documents
        WHERE length(content) > 4000 OR {_TOKENS} > 500
        UNION
        SELECT DISTINCT 'chunk' AS item_type, id AS item_id FROM chunks
        WHERE length(content) > 4000 OR {_TOKENS} > 500
    """,
}
