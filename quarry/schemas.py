"""Schemas of the entities, in DDL."""

from __future__ import annotations

# Field names and types of the exchange formats.
OCR_RESULT = "STRUCT<rec_texts:ARRAY<STRING>,rec_scores:ARRAY<DOUBLE>,rec_boxes:ARRAY<ARRAY<INT>>,rec_polys:ARRAY<ARRAY<ARRAY<INT>>>>"
OCR_PAGE = f"document_id STRING, source_pdf STRING, pdf_page INT, pdf_index INT, printed_page INT, elapsed_seconds DOUBLE, line_count INT, results ARRAY<{OCR_RESULT}>"
PDF_PAGE = "filename STRING, page_number INT, text STRING, blocks ARRAY<STRUCT<type:STRING,bbox:ARRAY<DOUBLE>,text:STRING>>"
OCR_LINE = "document_id STRING, pdf_page INT, line_index INT, source_line_id STRING, text STRING, score DOUBLE, box ARRAY<INT>"
BLOCK = (
    "block_id STRING, document_id STRING, batch_id STRING, pdf_page INT, pdf_index INT, printed_page INT, block_type STRING, layout_region STRING, text STRING, "
    "normalized_text STRING, title_path ARRAY<STRING>, source_line_ids ARRAY<STRING>, source_boxes ARRAY<ARRAY<INT>>, source_scores ARRAY<DOUBLE>, average_confidence DOUBLE, "
    "review_status STRING, issues ARRAY<STRING>"
)
CITATION = "STRUCT<document_id:STRING,document_title:STRING,pdf_pages:ARRAY<INT>,printed_pages:ARRAY<INT>,title_paths:ARRAY<STRING>,source_block_ids:ARRAY<STRING>,quote:STRING>"
CHUNK = (
    "chunk_id STRING, document_id STRING, strategy STRING, version STRING, text STRING, retrieval_text STRING, character_count INT, source_block_ids ARRAY<STRING>, "
    f"source_line_ids ARRAY<STRING>, pdf_pages ARRAY<INT>, printed_pages ARRAY<INT>, title_paths ARRAY<STRING>, block_types ARRAY<STRING>, issues ARRAY<STRING>, review_status STRING, citation {CITATION}"
)
FRAGMENTS = "ARRAY<STRUCT<block_id:STRING,block_character_start:INT,block_character_end:INT,block_character_count:INT,coverage:DOUBLE>>"
TOKEN_CHUNK = f"{CHUNK}, profile STRING, token_count INT, retrieval_token_count INT, target_tokens INT, overlap_tokens INT, source_fragments {FRAGMENTS}"
QUESTION = (
    "id STRING, question STRING, question_type STRING, knowledge_category STRING, cnc_system STRING, model STRING, difficulty STRING, requires_multi_hop BOOLEAN, source_page_hint ARRAY<INT>, "
    "annotation_status STRING, metadata STRUCT<contains_code:BOOLEAN,contains_terminology:BOOLEAN,speech_variant_needed:BOOLEAN>"
)
ANSWER = "question_id STRING, answer STRING, evidence_ids ARRAY<STRING>, answer_type STRING, safety_level STRING, requires_confirmation BOOLEAN, annotation_status STRING"
EVIDENCE = (
    "evidence_id STRING, document_id STRING, pdf_pages ARRAY<INT>, printed_pages ARRAY<INT>, title_path ARRAY<STRING>, source_block_ids ARRAY<STRING>, text STRING, review_status STRING, "
    "review_method STRING, reviewed_date STRING"
)
RETRIEVAL_LABEL = "question_id STRING, relevant_evidence ARRAY<STRUCT<evidence_id:STRING,relevance:INT,pdf_pages:ARRAY<INT>>>, annotation_status STRING"
CANDIDATES = "ARRAY<STRUCT<chunk_id:STRING,evidence_ids:ARRAY<STRING>,matched_source_block_ids:ARRAY<STRING>,source_fragment_coverage:MAP<STRING,DOUBLE>,evidence_coverage:MAP<STRING,DOUBLE>,proposed_relevance:INT>>"
GOLD_MAPPING = f"question_id STRING, strategy STRING, profile STRING, mapping_status STRING, relevant_chunk_candidates {CANDIDATES}"
RESULT = f"STRUCT<rank:INT,id:STRING,text:STRING,score:DOUBLE,citation:{CITATION},review_status:STRING,strategy:STRING>"
RETRIEVAL_RUN = f"experiment_id STRING, question_id STRING, relevant_ids ARRAY<STRING>, relevance MAP<STRING,DOUBLE>, retrieved_ids ARRAY<STRING>, results ARRAY<{RESULT}>"
REVIEW_ITEM = (
    "priority STRING, pdf_page INT, printed_page INT, block_id STRING, block_type STRING, reasons STRING, issues STRING, evidence_ids STRING, short_chunk_ids STRING, title_path STRING, "
    "text STRING, page_image STRING, review_status STRING, corrected_text STRING, corrected_title_path STRING, review_note STRING"
)
USER_CITATION = "ARRAY<STRUCT<citation_number:INT,chunk_id:STRING,document_id:STRING,document_title:STRING,section:STRING,printed_pages:ARRAY<INT>,pdf_pages:ARRAY<INT>,quote:STRING,retrieval_score:DOUBLE,display:STRING>>"
