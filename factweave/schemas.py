"""Schemas of the engine's tables; nothing is inferred at read time."""

QUALIFIERS = "array<struct<key:string,value:string>>"
QUANTITY = "struct<value:double,unit:string,dimension:string,raw:string>"
PERIOD = "struct<start:date,end:date,raw:string,kind:string>"
PAGES = "doc_id long, page int, text string, tables_text string"
RAW_FACTS = f"doc_id long, chunk int, ordinal int, fact_type string, subject string, predicate string, qualifiers {QUALIFIERS}, value_raw string, unit_hint string, period_raw string, page int, quote string, confidence double"
DOCUMENTS = "doc_id long, filename string, title string, publisher string, doc_date string, primary_entity string, fy_convention string, currency_hint string, page_count int, uploaded_at timestamp"
FACTS = f"fact_id long, doc_id long, page int, fact_type string, subject string, predicate string, qualifiers {QUALIFIERS}, claim_key string, value_raw string, value_num double, unit string, dimension string, period_raw string, period_start date, period_end date, period_kind string, source_quote string, quote_verified boolean, quote_score double, grounding string, confidence double, embedding array<float>"
RELATIONS = "fact_a_id long, fact_b_id long, relation_type string, decided_by string, explanation string, similarity double, confidence double"
VERDICTS = "fact_a_id long, fact_b_id long, relation_type string, explanation string, confidence double"
