"""Result columns of the registered queries whose type is changed at the
driver edge (generated by tools/gen_edge_types.py; the oracle test checks
the map is complete): exact decimals become doubles, dates become ISO
``yyyy-MM-dd`` text."""

DECIMAL_RESULT_COLUMNS = {
    'account_threshold_detect': ['current_balance', 'previous_balance', 'variance_amount'],
    'accounts_after_reload': ['typical_min', 'typical_max'],
    'adjust_thresholds': ['typical_min', 'typical_max'],
    'append_ledger': ['amount'],
    'apply_feedback': ['variance_amount'],
    'balances_from_deltas': ['net_balance'],
    'category_variance': ['net_balance', 'prev_balance', 'variance_amount'],
    'check_balance_domain': ['net_balance'],
    'detect_anomalies': ['current_balance', 'previous_balance', 'variance_amount'],
    'detect_anomalies_hot_account': ['current_balance', 'previous_balance', 'variance_amount'],
    'detect_anomalies_lineitem': ['current_balance', 'previous_balance', 'variance_amount'],
    'detect_anomalies_sparse': ['current_balance', 'previous_balance', 'variance_amount'],
    'detect_month': ['current_balance', 'previous_balance', 'variance_amount'],
    'filter_month': ['net_balance'],
    'filter_variance': ['net_balance', 'prev_month_balance', 'variance_amount'],
    'flag_material': ['net_balance', 'prev_month_balance', 'variance_amount'],
    'generate_accounts': ['typical_min', 'typical_max'],
    'generate_ledger': ['amount'],
    'generate_month': ['amount'],
    'high_severity_list': ['variance_amount'],
    'join_accounts': ['net_balance', 'typical_min', 'typical_max'],
    'late_rows': ['ledger_balance', 'stored_balance'],
    'load_all_months': ['amount'],
    'mom_variance': ['net_balance', 'prev_month_balance', 'variance_amount'],
    'mom_variance_dense': ['net_balance', 'prev_month_balance', 'variance_amount'],
    'monthly_balances': ['net_balance'],
    'monthly_balances_for': ['net_balance'],
    'new_transactions': ['amount'],
    'past_anomaly_count': ['current_balance', 'previous_balance', 'variance_amount'],
    'project_accounts': ['typical_min', 'typical_max'],
    'project_ledger': ['amount'],
    'quarantine_ledger': ['amount'],
    'recent_history': ['variance_amount'],
    'refresh_balances': ['net_balance', 'prev_month_balance', 'variance_amount'],
    'reuse_stats': ['size_mb'],
    'scan_accounts': ['typical_min', 'typical_max'],
    'scan_accounts_csv': ['typical_min', 'typical_max'],
    'seasonal_break': ['net_balance', 'year_ago_balance', 'yoy_amount'],
    'sink_ledger_csv': ['amount'],
    'sort_ledger': ['amount'],
    'store_feedback': ['variance_amount'],
    'store_investigations': ['variance_amount'],
    'stream_dedupe': ['amount'],
    'stream_ledger': ['current_balance', 'previous_balance', 'variance_amount'],
    'stream_ledger_files': ['amount'],
    'stream_monthly_balances': ['net_balance'],
    'table_read': ['net_balance'],
    'upsert_accounts': ['typical_min', 'typical_max'],
    'zscore_outliers': ['net_balance'],
}

DATE_RESULT_COLUMNS = {
    'account_threshold_after_feedback': ['month'],
    'account_threshold_detect': ['month'],
    'append_ledger': ['transaction_date'],
    'apply_feedback': ['detected_month'],
    'approval_route': ['month'],
    'balances_from_deltas': ['month'],
    'category_variance': ['month'],
    'check_balance_domain': ['month'],
    'check_flag_domain': ['month'],
    'detect_after_reload': ['month'],
    'detect_anomalies': ['month'],
    'detect_anomalies_hot_account': ['month'],
    'detect_anomalies_lineitem': ['month'],
    'detect_anomalies_sparse': ['month'],
    'detect_month': ['month'],
    'explain_anomalies': ['month'],
    'explanation_requests': ['month'],
    'filter_month': ['month'],
    'filter_variance': ['month'],
    'flag_material': ['month'],
    'generate_ledger': ['transaction_date'],
    'generate_month': ['transaction_date'],
    'join_accounts': ['month'],
    'late_rows': ['month'],
    'ledger_partition_counts': ['month'],
    'load_all_months': ['transaction_date'],
    'mom_variance': ['month'],
    'mom_variance_dense': ['month'],
    'monthly_balances': ['month'],
    'monthly_balances_for': ['month'],
    'new_transactions': ['transaction_date'],
    'observed_months': ['month', 'prev_observed_month'],
    'past_anomaly_count': ['month'],
    'previous_observed_month': ['month', 'prev_observed_month'],
    'project_ledger': ['transaction_date'],
    'rank_anomalies': ['month'],
    'recent_history': ['detected_month'],
    'refresh_balances': ['month'],
    'report_sections': ['month'],
    'retrieval_queries': ['month'],
    'rolling_avg': ['month'],
    'rolling_std': ['month'],
    'seasonal_break': ['month'],
    'sink_ledger_csv': ['transaction_date'],
    'sort_ledger': ['transaction_date'],
    'store_feedback': ['detected_month'],
    'store_investigations': ['detected_month'],
    'stream_dedupe': ['transaction_date'],
    'stream_ledger': ['month'],
    'stream_ledger_files': ['transaction_date'],
    'stream_monthly_balances': ['month'],
    'table_read': ['month'],
    'top_medium': ['month'],
    'zscore_outliers': ['month'],
}
