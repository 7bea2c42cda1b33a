"""Date columns of the queries' results; both sides of the comparison give them as ISO text."""

DATES = {
    "p1_trading_slice": "date",
    "u3_set_plus": "date",
    "s13_versioned_upsert": "date",
    "r6_path_rows": "start",
    "w1_filled_blocks": "date",
    "j6_as_of_blocks": "date training_date",
    "j8_join_fill_blocks": "date",
    "m7_training_windows": "window_start",
    "m7_walk_forward": "data_cutoff_date window_start",
    "m10_scored_cutoffs": "window_start",
    "unified_daily": "date",
    "w3_latest_wins": "date",
    "w4_most_complete": "date",
    "w5_latest_row": "date",
    "w18_last_n": "since",
    "f6_j1_j2_w1_filled_market": "date",
    "w2_ffill_series": "date",
    "j4_missing_dates": "date",
    "j6_as_of": "date training_date",
    "j7_merge_series": "date",
    "j8_join_ffill": "date",
    "j9_join_zero": "date",
    "j11_version_diff": "date",
    "j13_latest_only": "date",
    "a1_region_mean": "date",
    "a2_region_weighted": "date",
    "a3_numeric_mean": "date",
    "a13_completeness": "first_day last_day",
    "a15_freshness": "latest",
    "a16_presence": "date",
    "w6_lags": "date",
    "w7_rolling": "date",
    "w8_diffs": "date",
    "w9_rolling_full": "date",
    "w10_rsi_momentum_vol": "date",
    "w11_macd": "date",
    "w12_bollinger": "date",
    "w13_channel": "date",
    "w14_trend_slope": "date",
    "w16_gaps": "date previous",
    "w17_outliers": "date",
    "w20_change_high_low": "date",
    "w22_hist_vol": "date",
    "w23_crossings": "date",
    "f7_calendar": "date",
    "f8_cyclic": "date",
    "f9_fourier": "date",
    "f10_interactions": "date",
    "f11_regime": "date",
    "f12_scale": "date",
    "m1_naive": "data_cutoff_date forecast_date",
    "m3_persist": "date",
    "m4_seasonal": "date",
    "m6_at_cutoffs": "data_cutoff_date",
    "m11_retrain_due": "last_training next_training",
    "w27_walk_windows": "train_end test_start test_end",
    "w28_folds": "first_day last_day",
    "p1_as_of_slice": "date",
    "p4_match_newer": "date",
    "p7_ohlc_violations": "date",
    "p9_frost_band": "date",
    "k2_top_k": "date",
    "u3_set_minus": "date",
    "u6_key_diff": "date",
    "f1_f2_parse": "article_date",
    "f3_explode_themes": "article_date",
    "a4_theme_agg": "article_date",
    "f4_a5_group_agg": "article_date",
    "r1_pivot_news": "article_date",
    "a30_event_counts": "date",
    "r3_pivot_days": "start",
    "r5_actual_windows": "start",
    "a7_distribution_summary": "start",
    "e5_window_scores": "start",
    "e17_a29_validate_paths": "start",
    "f17_path_features": "start",
    "f18_f19_tiers": "start",
    "f20_best_window": "start",
    "e19_signal_sharpe": "start",
    "w19_best_flag": "start",
    "w30_retain": "start",
    "w24_portfolio_value": "date",
    "w25_harvest_schedule": "date",
    "w26_foresight_bound": "date",
    "j14_pair": "date",
    "w21_w23_indicators": "date",
    "g1_threshold_signal": "date",
    "g2_crossover_signal": "date",
    "g4_ev_signal": "start",
    "g5_consensus_signal": "start",
    "g6_risk_signal": "start",
    "g7_horizon_signal": "start",
    "g8_hold_or_sell": "start",
    "g10_decision_diff": "start",
    "g11_vote": "date",
    "s10_discover": "day",
    "s12_backlog": "day",
    "s13_upsert_columns": "date",
    "f5_file_day": "file_day",
    "f14_cadence": "training_date",
    "u5_keep_last": "date",
    "e7_pending_windows": "start",
    "e6_score_table": "start",
    "p5_leakage_flag": "date cutoff",
    "m7_pooled_trees": "date",
    "st3_stream_tone": "window_start",
    "j3_trading_days": "date",
    "j5_with_actuals": "start",
    "j12_with_stats": "date",
    "w15_sentiment": "date",
    "k1_ordered_output": "date",
    "k4_recent": "date",
    "k5_overlapping": "target",
    "u1_stack_rows": "date",
    "p6_select_prefix": "date",
    "p10_convert_units": "date",
    "r4_pivot_regions": "date",
    "r6_path_arrays": "start",
    "s9_rebuild": "date",
    "f12_minmax": "date",
    "f13_row_means": "article_date",
    "f15_day_ahead": "start",
    "g3_prediction_override": "start",
    "p8_range_examples": "date",
    "a29_path_inventory": "first_start last_start",
    "e17_path_validity": "start",
    "e6_score_upsert": "start",
    "f12_restored": "date",
    "g11_primary_vote": "date",
    "j6_training_date": "date training_date",
    "m6_all_at_cutoffs": "data_cutoff_date",
    "m10_fan_out": "data_cutoff_date training_date",
    "w15_sentiment_spans": "date",
}
