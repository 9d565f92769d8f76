"""Declared schemas of the tables read and written.

Fixed values: column names and types. The relevance flag is text because one of its values
is ``0,5``; ``none`` is a grade, never a null.
"""

REVIEWS = """id long, reviewer_id long, sample_id long, smell string, severity string, review_timestamp timestamp,
type string, code_name string, repository string, commit_hash string, path string, start_line int, end_line int,
link string, is_from_industry_relevant_project string"""

INSTANCES = """instance_id string, sample_id long, smell string, type string, code_name string, repository string,
commit_hash string, path string, start_line int, end_line int, link string, is_from_industry_relevant_project_raw string,
n_reviewers int, severity_consensus string, severity_tied boolean, severity_values_seen string"""

PERSISTENCE = """instance_id string, sample_id long, smell string, severity_consensus string, repository string,
path_at_label string, code_name string, original_commit_hash string, commit_remapped boolean,
effective_commit_hash string, head_sha_used string, n_revisions_observed long, persistence_revisions long,
persistence_days long, days_anomalous_negative boolean, censored boolean, death_reason string,
labelled_commit_date timestamp, death_commit string, death_commit_date timestamp, last_observed_commit string,
last_observed_commit_date timestamp, proxy_method string"""

COMPLEXITY = """instance_id string, sample_id long, smell string, severity_consensus string, repository string,
original_commit_hash string, commit_remapped boolean, effective_commit_hash string, path_at_label string,
code_name string, join_level string, wmc double, cbo double, dit double, noc double, rfc double, lcom double,
loc double, total_methods double, total_fields double, method_cyclomatic_complexity double, ck_version string"""

FAILURES = """repository string, instance_id string, sample_id long, smell string, stage string, reason string,
detail string, timestamp timestamp"""

CLONE_LOG = """repository string, local_dir string, status string, seconds double, size_bytes long, size_human string,
timestamp timestamp, error string"""

CLASS_METRICS = """file string, class string, wmc double, cbo double, dit double, noc double, rfc double, lcom double,
loc double, totalMethodsQty double, totalFieldsQty double"""

METHOD_METRICS = "class string, method string, cbo double, rfc double, loc double, wmc double"
