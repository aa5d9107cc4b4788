"""All queries and their SQL, by name."""

from rallyloom.plans import oracles_curation, oracles_events, queries_curation, queries_events, queries_files, queries_streaming

QUERIES = {**queries_events.QUERIES, **queries_curation.QUERIES, **queries_streaming.QUERIES, **queries_files.QUERIES}
#: A drained stream of whole sessions holds what the batch query holds, without numbers.
ORACLES = {
    **oracles_events.ORACLES,
    **oracles_curation.ORACLES,
    "streaming_rallies": f"{oracles_events.BASE} SELECT clip, start_frame, end_frame, net_crossings FROM ral",
    "streaming_track": oracles_events.ORACLES["kalman_track"],
    "streaming_tumbling": f"{oracles_events.CANDIDATES} SELECT clip, (f // 100 * 100)::BIGINT AS start_frame, count(*) AS n FROM cand GROUP BY 1, 2",
    "streaming_sliding": f"{oracles_events.CANDIDATES} SELECT clip, s::BIGINT AS start_frame, count(*) AS n FROM cand, range(-80, 400000, 40) w(s) WHERE f >= s AND f < s + 100 GROUP BY 1, 2",
    **queries_files.ORACLES,
}
