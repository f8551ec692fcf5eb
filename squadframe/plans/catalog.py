"""All queries of the engine by name; the llm queries are added elsewhere."""

from __future__ import annotations

from ..operators import cleaning, dashboard, payload, ranker, recommend, search, stats, text, votes
from ..streaming import state

QUERIES = {
    f.__name__: f
    for f in (
        stats.official_candidate_stats, stats.official_trait_build, stats.official_trait_top5, stats.official_composition_stats, stats.official_pair_stats, stats.recency_weighted_pairs,
        stats.official_combat_stats, stats.drop_reason_audit, stats.unmapped_codes, stats.team_dedup_first_wins, stats.weapon_majority_map, stats.stat_id_resolution, stats.tournament_compositions,
        stats.ml_team_features, stats.bayes_character_power, stats.bayes_pair_synergy, stats.official_v2_score, stats.tournament_result_score, stats.official_candidate_score, stats.combat_signal, stats.composition_ranking, stats.stat_id_by_code, stats.tier_buckets, stats.tier_bucket_text,
        votes.vote_upsert_hourly, votes.vote_summary, votes.vote_duplicates, votes.vote_ttl_purge, votes.vote_window_counts, votes.popular_feedback_overall, votes.popular_feedback_recent, votes.character_feedback, votes.relationship_score, votes.feedback_score, state.streamed_first_teams, state.streamed_recent_votes,
        search.union_combos, search.union_combos_capped, search.full_team_beam, search.pair_stat_fallback, search.union_combos_scored, search.full_team_recommend, search.nearest_template, search.graph_expand_depth2, search.graph_expand_capped, search.seed_pool_rotation, search.random_seed_sample,
        ranker.ranker_candidate_stats, ranker.ranker_composition_stats, ranker.tier_snapshot_argmax,
        recommend.member_predicates, recommend.team_shape, recommend.team_metric_profile, recommend.score_rules, recommend.score_references, recommend.official_meta_score, recommend.official_fallback_scores, recommend.group_average_fallback, recommend.tier_alias_fallback, recommend.damage_reference, recommend.recommend_topk,
        dashboard.character_ranking, dashboard.character_rank_tiers, dashboard.combined_composition_ranking, dashboard.ranker_composition_ranking, dashboard.official_composition_score,
        cleaning.scalar_rules, cleaning.korean_search, cleaning.member_filter, cleaning.feedback_validity, cleaning.ml_manifest, cleaning.roster_normalize, cleaning.name_override_join, cleaning.trait_name_from_order, cleaning.tournament_payload, cleaning.tier_breakdown,
        cleaning.vote_upsert_daily, cleaning.recovered_votes, cleaning.feedback_union, cleaning.tag_sets, cleaning.unmapped_code_order, cleaning.id_range_scan, cleaning.fixed_digits, cleaning.html_metrics, cleaning.reason_labels, cleaning.preset_names, cleaning.source_scan, cleaning.team_reasons, cleaning.detected_team,
        payload.json_schema_discovery, payload.payload_discovery, payload.payload_arrays, payload.payload_objects, payload.raw_game_teams, payload.payload_coalesce_project,
        text.html_strip, text.name_normalize, text.csv_escape, text.html_escape, text.initial_search, text.feedback_key_parse, text.i18n_render,
    )
}
