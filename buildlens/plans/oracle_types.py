"""Generated by tools/gen_oracle_types.py: output column types of each query (DuckDB names)."""

TYPES = {'attention_fuse': [('global_index', 'BIGINT'),
                    ('w_message', 'DOUBLE'),
                    ('w_diff', 'DOUBLE'),
                    ('w_context', 'DOUBLE'),
                    ('fused_sum', 'DOUBLE')],
 'available_commits': [('source_row_index', 'BIGINT'), ('repo', 'VARCHAR'), ('commit_sha', 'VARCHAR')],
 'bce_loss': [('loss', 'DOUBLE'), ('error', 'DOUBLE')],
 'binary_metrics': [('accuracy', 'DOUBLE'), ('precision', 'DOUBLE'), ('recall', 'DOUBLE'), ('f1', 'DOUBLE')],
 'changed_files': [('repo', 'VARCHAR'),
                   ('commit_sha', 'VARCHAR'),
                   ('file_order', 'INTEGER'),
                   ('path', 'VARCHAR')],
 'changed_lines': [('repo', 'VARCHAR'),
                   ('commit_sha', 'VARCHAR'),
                   ('file_order', 'INTEGER'),
                   ('n_changed', 'BIGINT'),
                   ('first_changed', 'INTEGER[]')],
 'class_weights': [('label', 'INTEGER'), ('weight', 'DOUBLE')],
 'commit_source': [('repo', 'VARCHAR'),
                   ('commit_sha', 'VARCHAR'),
                   ('n_files', 'BIGINT'),
                   ('n_with_content', 'BIGINT'),
                   ('message', 'VARCHAR')],
 'confusion_matrix': [('matrix', 'BIGINT[][]')],
 'confusion_table': [('actual', 'INTEGER'), ('predicted_0', 'BIGINT'), ('predicted_1', 'BIGINT')],
 'context_provenance': [('repo', 'VARCHAR'),
                        ('commit_sha', 'VARCHAR'),
                        ('regions_retained', 'BIGINT'),
                        ('original_char_count', 'BIGINT'),
                        ('retained_char_count', 'BIGINT'),
                        ('extraction_truncated', 'BOOLEAN')],
 'context_region': [('repo', 'VARCHAR'),
                    ('commit_sha', 'VARCHAR'),
                    ('file_order', 'INTEGER'),
                    ('line_no', 'INTEGER'),
                    ('start_line', 'INTEGER'),
                    ('end_line', 'INTEGER'),
                    ('symbol_name', 'VARCHAR'),
                    ('symbol_type', 'VARCHAR'),
                    ('extraction_method', 'VARCHAR'),
                    ('text', 'VARCHAR')],
 'context_regions': [('repo', 'VARCHAR'),
                     ('commit_sha', 'VARCHAR'),
                     ('file_path', 'VARCHAR'),
                     ('start_line', 'INTEGER'),
                     ('end_line', 'INTEGER'),
                     ('extraction_method', 'VARCHAR'),
                     ('symbol_name', 'VARCHAR'),
                     ('triggering_changed_lines', 'INTEGER[]'),
                     ('truncated', 'BOOLEAN'),
                     ('n_occurrences', 'BIGINT'),
                     ('first_start_offset', 'BIGINT'),
                     ('first_rank', 'BIGINT'),
                     ('retained_char_count', 'INTEGER')],
 'context_text': [('repo', 'VARCHAR'), ('commit_sha', 'VARCHAR'), ('text', 'VARCHAR')],
 'context_text_capped': [('repo', 'VARCHAR'), ('commit_sha', 'VARCHAR'), ('text', 'VARCHAR')],
 'context_window': [('repo', 'VARCHAR'),
                    ('commit_sha', 'VARCHAR'),
                    ('file_order', 'INTEGER'),
                    ('line_no', 'INTEGER'),
                    ('start_line', 'INTEGER'),
                    ('end_line', 'INTEGER'),
                    ('text', 'VARCHAR')],
 'diff_git_paths': [('repo', 'VARCHAR'),
                    ('commit_sha', 'VARCHAR'),
                    ('file_order', 'INTEGER'),
                    ('old_path', 'VARCHAR'),
                    ('new_path', 'VARCHAR')],
 'diff_header_meta': [('repo', 'VARCHAR'),
                      ('commit_sha', 'VARCHAR'),
                      ('file_order', 'INTEGER'),
                      ('old_path', 'VARCHAR'),
                      ('new_path', 'VARCHAR'),
                      ('change_type', 'VARCHAR'),
                      ('binary', 'BOOLEAN')],
 'diff_offsets': [('repo', 'VARCHAR'),
                  ('commit_sha', 'VARCHAR'),
                  ('file_order', 'INTEGER'),
                  ('start_offset', 'BIGINT'),
                  ('end_offset', 'BIGINT'),
                  ('diff_start_offset', 'BIGINT'),
                  ('diff_end_offset', 'BIGINT')],
 'diff_provenance': [('repo', 'VARCHAR'),
                     ('commit_sha', 'VARCHAR'),
                     ('source_type', 'VARCHAR'),
                     ('files_found', 'BIGINT'),
                     ('files_retained', 'BIGINT'),
                     ('original_char_count', 'BIGINT'),
                     ('retained_char_count', 'INTEGER'),
                     ('extraction_truncated', 'BOOLEAN'),
                     ('retained_file_order', 'VARCHAR[]')],
 'diff_text': [('repo', 'VARCHAR'), ('commit_sha', 'VARCHAR'), ('text', 'VARCHAR')],
 'diff_text_capped': [('repo', 'VARCHAR'), ('commit_sha', 'VARCHAR'), ('text', 'VARCHAR')],
 'duplicate_ids': [('sample_id', 'VARCHAR'), ('n_new', 'BIGINT'), ('n_committed', 'BIGINT')],
 'embedding_dims': [('message_embedding_n_dims', 'BIGINT'),
                    ('diff_embedding_n_dims', 'BIGINT'),
                    ('context_embedding_n_dims', 'BIGINT'),
                    ('message_embedding_dim', 'INTEGER'),
                    ('diff_embedding_dim', 'INTEGER'),
                    ('context_embedding_dim', 'INTEGER'),
                    ('rows_with_unequal_dims', 'BIGINT')],
 'failure_identity': [('repo', 'VARCHAR'),
                      ('commit_sha', 'VARCHAR'),
                      ('source_row_index', 'BIGINT'),
                      ('build_id', 'VARCHAR'),
                      ('parent_commit_sha', 'VARCHAR'),
                      ('sample_id', 'VARCHAR')],
 'failure_log': [('stage', 'VARCHAR'),
                 ('repo', 'VARCHAR'),
                 ('commit_sha', 'VARCHAR'),
                 ('source_row_index', 'BIGINT'),
                 ('build_id', 'VARCHAR'),
                 ('parent_commit_sha', 'VARCHAR'),
                 ('sample_id', 'VARCHAR'),
                 ('error', 'VARCHAR')],
 'feature_concat': [('global_index', 'BIGINT'),
                    ('n_features', 'INTEGER'),
                    ('feature_sum', 'DOUBLE'),
                    ('first_diff_value', 'FLOAT')],
 'file_metadata': [('repo', 'VARCHAR'),
                   ('commit_sha', 'VARCHAR'),
                   ('file_order', 'INTEGER'),
                   ('old_path', 'VARCHAR'),
                   ('new_path', 'VARCHAR'),
                   ('change_type', 'VARCHAR')],
 'first_n_from_shards': [('shard_index', 'INTEGER'),
                         ('record_index', 'INTEGER'),
                         ('repo', 'VARCHAR'),
                         ('label', 'INTEGER')],
 'first_n_samples': [('global_index', 'BIGINT'), ('repo', 'VARCHAR'), ('label', 'INTEGER')],
 'function_span': [('repo', 'VARCHAR'),
                   ('commit_sha', 'VARCHAR'),
                   ('file_order', 'INTEGER'),
                   ('line_no', 'INTEGER'),
                   ('start_line', 'INTEGER'),
                   ('end_line', 'INTEGER'),
                   ('symbol_name', 'VARCHAR')],
 'fusion_predict': [('n', 'BIGINT'), ('error', 'DOUBLE')],
 'fusion_score': [('sample_id', 'VARCHAR'),
                  ('label', 'INTEGER'),
                  ('logit', 'DOUBLE'),
                  ('probability', 'DOUBLE'),
                  ('prediction', 'INTEGER'),
                  ('attention', 'DOUBLE[]')],
 'half_round': [('vec_id', 'BIGINT'), ('embedding_half', 'FLOAT[]')],
 'hash_embedding': [('doc_id', 'BIGINT'), ('embedding', 'FLOAT[]')],
 'hash_embedding_udf': [('doc_id', 'BIGINT'), ('embedding', 'FLOAT[]')],
 'incremental_ingest': [('sample_id', 'VARCHAR'),
                        ('repo', 'VARCHAR'),
                        ('commit_sha', 'VARCHAR'),
                        ('label', 'INTEGER')],
 'iso_utc': [('event_id', 'BIGINT'), ('ts_iso', 'VARCHAR')],
 'label_counts': [('label', 'INTEGER'), ('n_samples', 'BIGINT')],
 'label_repair': [('global_index', 'BIGINT'), ('label_repaired', 'INTEGER'), ('label_error', 'BOOLEAN')],
 'labels_float': [('source_row_index', 'BIGINT'), ('label_float', 'FLOAT')],
 'manifest_shards': [('shard_index', 'INTEGER'), ('num_samples', 'BIGINT'), ('shard_name', 'VARCHAR')],
 'manifest_totals': [('successful_samples', 'BIGINT'), ('failed_samples', 'BIGINT'), ('shards', 'BIGINT')],
 'manifest_validate': [('n_entries', 'BIGINT'),
                       ('n_distinct', 'BIGINT'),
                       ('min_index', 'INTEGER'),
                       ('max_index', 'INTEGER'),
                       ('bad_names', 'BIGINT'),
                       ('bad_counts', 'BIGINT'),
                       ('total_samples', 'BIGINT'),
                       ('valid', 'BOOLEAN')],
 'max_repos': [('source_row_index', 'BIGINT'), ('repo', 'VARCHAR')],
 'mean_pool': [('label', 'INTEGER'), ('mean_vector', 'DOUBLE[]')],
 'message_artifact': [('repo', 'VARCHAR'),
                      ('commit_sha', 'VARCHAR'),
                      ('text', 'VARCHAR'),
                      ('original_char_count', 'INTEGER'),
                      ('retained_char_count', 'INTEGER'),
                      ('extraction_truncated', 'BOOLEAN')],
 'missing_commits': [('stage', 'VARCHAR'),
                     ('repo', 'VARCHAR'),
                     ('commit_sha', 'VARCHAR'),
                     ('source_row_index', 'BIGINT'),
                     ('build_id', 'VARCHAR'),
                     ('parent_commit_sha', 'VARCHAR'),
                     ('sample_id', 'VARCHAR'),
                     ('error', 'VARCHAR')],
 'missing_keys': [('global_index', 'BIGINT'), ('missing_keys', 'VARCHAR[]')],
 'name_status': [('repo', 'VARCHAR'),
                 ('commit_sha', 'VARCHAR'),
                 ('key_path', 'VARCHAR'),
                 ('old_path', 'VARCHAR'),
                 ('new_path', 'VARCHAR'),
                 ('change_type', 'VARCHAR')],
 'nearest_signature': [('repo', 'VARCHAR'),
                       ('commit_sha', 'VARCHAR'),
                       ('file_order', 'INTEGER'),
                       ('line_no', 'INTEGER'),
                       ('signature_line', 'INTEGER')],
 'normalize_label': [('source_row_index', 'BIGINT'), ('raw_status', 'VARCHAR'), ('label', 'INTEGER')],
 'normalize_optional': [('source_row_index', 'BIGINT'),
                        ('build_id_text', 'VARCHAR'),
                        ('parent_text', 'VARCHAR'),
                        ('status_text', 'VARCHAR')],
 'orphan_shards': [('shard_index', 'INTEGER'), ('n_kinds', 'BIGINT'), ('action', 'VARCHAR')],
 'patch_hunks': [('repo', 'VARCHAR'),
                 ('commit_sha', 'VARCHAR'),
                 ('file_order', 'INTEGER'),
                 ('hunk', 'BIGINT'),
                 ('old_start', 'INTEGER'),
                 ('old_count', 'INTEGER'),
                 ('new_start', 'INTEGER'),
                 ('new_count', 'INTEGER'),
                 ('added_line_numbers', 'BIGINT[]'),
                 ('removed_line_numbers', 'BIGINT[]'),
                 ('start_offset', 'BIGINT'),
                 ('end_offset', 'BIGINT')],
 'patch_line_numbers': [('repo', 'VARCHAR'),
                        ('commit_sha', 'VARCHAR'),
                        ('file_order', 'INTEGER'),
                        ('added_line_numbers', 'BIGINT[]'),
                        ('removed_line_numbers', 'BIGINT[]')],
 'portable_path': [('page_id', 'BIGINT'), ('file_name', 'VARCHAR')],
 'preprocess_failures': [('stage', 'VARCHAR'), ('n', 'BIGINT')],
 'preprocess_samples': [('sample_id', 'VARCHAR'),
                        ('shard_index', 'INTEGER'),
                        ('record_index', 'INTEGER'),
                        ('label', 'INTEGER'),
                        ('diff_chars', 'INTEGER'),
                        ('message_chars', 'INTEGER')],
 'repo_attempts': [('repo', 'VARCHAR'),
                   ('attempted', 'BIGINT'),
                   ('successful', 'BIGINT'),
                   ('failed', 'BIGINT')],
 'repo_counts': [('repo', 'VARCHAR'), ('n_samples', 'BIGINT')],
 'repo_failures': [('stage', 'VARCHAR'),
                   ('repo', 'VARCHAR'),
                   ('commit_sha', 'VARCHAR'),
                   ('source_row_index', 'BIGINT'),
                   ('build_id', 'VARCHAR'),
                   ('parent_commit_sha', 'VARCHAR'),
                   ('sample_id', 'VARCHAR'),
                   ('error', 'VARCHAR')],
 'repo_first_seen': [('repo', 'VARCHAR'), ('n_samples', 'BIGINT'), ('first_seen', 'BIGINT')],
 'repo_order': [('repo', 'VARCHAR'), ('source_row_index', 'BIGINT'), ('global_position', 'BIGINT')],
 'repo_shuffle': [('repo', 'VARCHAR'), ('shuffle_rank', 'BIGINT')],
 'repo_split': [('repo', 'VARCHAR'), ('split', 'VARCHAR')],
 'repo_split_builds': [('repo', 'VARCHAR'), ('split', 'VARCHAR')],
 'repo_summary': [('repo', 'VARCHAR'),
                  ('samples', 'BIGINT'),
                  ('successes', 'BIGINT'),
                  ('failures', 'BIGINT'),
                  ('unlabeled', 'BIGINT')],
 'repos_by_size': [('repo', 'VARCHAR'),
                   ('n_samples', 'BIGINT'),
                   ('first_seen', 'BIGINT'),
                   ('size_rank', 'BIGINT')],
 'result_table': [('doc_id', 'BIGINT'),
                  ('label', 'INTEGER'),
                  ('prediction', 'INTEGER'),
                  ('accuracy', 'INTEGER')],
 'resume_accounting': [('repo', 'VARCHAR'),
                       ('rows_seen', 'BIGINT'),
                       ('rows_completed', 'BIGINT'),
                       ('rows_remaining', 'BIGINT'),
                       ('repo_skipped', 'BOOLEAN')],
 'resume_antijoin': [('source_row_index', 'BIGINT'), ('sample_id', 'VARCHAR')],
 'run_summary': [('attempted_rows', 'BIGINT'),
                 ('successful_samples', 'BIGINT'),
                 ('failed_samples', 'BIGINT'),
                 ('samples_per_second', 'DOUBLE')],
 'sample_id': [('source_row_index', 'BIGINT'), ('sample_id', 'VARCHAR')],
 'sample_subset': [('pos', 'BIGINT'), ('global_index', 'BIGINT'), ('repo', 'VARCHAR')],
 'scan_builds': [('source_row_index', 'BIGINT'),
                 ('repo', 'VARCHAR'),
                 ('commit_sha', 'VARCHAR'),
                 ('parent_commit_sha', 'VARCHAR'),
                 ('build_id', 'VARCHAR'),
                 ('raw_status', 'VARCHAR'),
                 ('label', 'INTEGER'),
                 ('sample_id', 'VARCHAR')],
 'scan_builds_csv': [('source_row_index', 'BIGINT'),
                     ('repo', 'VARCHAR'),
                     ('commit_sha', 'VARCHAR'),
                     ('parent_commit_sha', 'VARCHAR'),
                     ('build_id', 'VARCHAR'),
                     ('raw_status', 'VARCHAR'),
                     ('label', 'INTEGER'),
                     ('sample_id', 'VARCHAR')],
 'scan_builds_missing_cols': [('source_row_index', 'BIGINT'),
                              ('repo', 'VARCHAR'),
                              ('commit_sha', 'VARCHAR'),
                              ('parent_commit_sha', 'VARCHAR'),
                              ('build_id', 'VARCHAR'),
                              ('raw_status', 'VARCHAR'),
                              ('label', 'INTEGER'),
                              ('sample_id', 'VARCHAR')],
 'shard_assign': [('sample_id', 'VARCHAR'), ('shard_index', 'INTEGER'), ('record_index', 'INTEGER')],
 'shard_name_codec': [('o_orderkey', 'BIGINT'),
                      ('shard_name', 'VARCHAR'),
                      ('parsed_index', 'INTEGER'),
                      ('junk_parsed', 'INTEGER')],
 'shard_scan': [('shard_index', 'INTEGER'), ('num_samples', 'BIGINT'), ('message_sum', 'DOUBLE')],
 'shard_states': [('shard_index', 'INTEGER'),
                  ('has_vectors', 'BOOLEAN'),
                  ('has_text', 'BOOLEAN'),
                  ('has_tmp', 'BOOLEAN'),
                  ('state', 'VARCHAR')],
 'shard_union': [('shard_index', 'INTEGER'), ('num_samples', 'BIGINT')],
 'shard_validate': [('shard_index', 'INTEGER'),
                    ('num_samples', 'BIGINT'),
                    ('distinct_ids', 'BIGINT'),
                    ('min_record', 'INTEGER'),
                    ('max_record', 'INTEGER'),
                    ('distinct_records', 'BIGINT'),
                    ('valid', 'BOOLEAN')],
 'shard_write_roundtrip': [('shard_index', 'INTEGER'),
                           ('record_index', 'INTEGER'),
                           ('sample_id', 'VARCHAR'),
                           ('repo', 'VARCHAR'),
                           ('label', 'INTEGER'),
                           ('dim', 'INTEGER')],
 'sidecar_alignment': [('shard_index', 'INTEGER'),
                       ('record_index', 'INTEGER'),
                       ('payload_id', 'VARCHAR'),
                       ('sidecar_id', 'VARCHAR')],
 'sidecar_json': [('shard_index', 'INTEGER'), ('record_index', 'INTEGER'), ('json', 'VARCHAR')],
 'sidecar_records': [('shard_index', 'INTEGER'),
                     ('record_index', 'INTEGER'),
                     ('sample_id', 'VARCHAR'),
                     ('repo', 'VARCHAR'),
                     ('label', 'INTEGER')],
 'signature_lines': [('repo', 'VARCHAR'),
                     ('commit_sha', 'VARCHAR'),
                     ('file_order', 'INTEGER'),
                     ('line_no', 'INTEGER'),
                     ('symbol_name', 'VARCHAR')],
 'source_row_index': [('o_orderkey', 'BIGINT'), ('source_row_index', 'BIGINT')],
 'split_counts': [('split', 'VARCHAR'), ('n_samples', 'BIGINT'), ('n_repos', 'BIGINT')],
 'sweep_sizes': [('budget', 'INTEGER'), ('split', 'VARCHAR'), ('n_samples', 'BIGINT')],
 'threshold_predict': [('global_index', 'BIGINT'), ('prediction', 'INTEGER')],
 'token_counts': [('doc_id', 'BIGINT'),
                  ('token_count_before_truncation', 'INTEGER'),
                  ('retained_token_count', 'INTEGER'),
                  ('was_tokenizer_truncated', 'BOOLEAN')],
 'truncate_text': [('doc_id', 'BIGINT'), ('retained_chars', 'INTEGER'), ('truncated', 'BOOLEAN')],
 'unpaired_shards': [('shard_index', 'INTEGER'), ('missing', 'VARCHAR')]}
