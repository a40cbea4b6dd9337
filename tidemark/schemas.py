"""The canonical tables.  Times are epoch milliseconds; a null expiry never comes."""

REVISION_LOG = (
    "key STRING, bucket STRING, revision BIGINT, value STRING, ts_l BIGINT, expires_l BIGINT, state STRING, no_revision BOOLEAN"
)
MUTATIONS = (
    "seq BIGINT, op STRING, key STRING, value STRING, nx BOOLEAN, xx BOOLEAN, cmp_value STRING, cmp_rev BIGINT, "
    "norev BOOLEAN, ttl_ms BIGINT, ts_l BIGINT"
)
MUTATION_RESULT = (
    "key STRING, seq BIGINT, op STRING, status STRING, revision BIGINT, value STRING, ts_l BIGINT, expires_l BIGINT, state STRING"
)
LOCK_LOG = "seq BIGINT, op STRING, resource STRING, owner STRING, ttl_ms BIGINT, ts_l BIGINT"
LOCK_RESULT = "resource STRING, seq BIGINT, op STRING, owner STRING, status STRING, token BIGINT, expires_l BIGINT"
SEQUENCE_REQUESTS = "seq BIGINT, name STRING, count BIGINT, idempotency_key STRING, ts_l BIGINT"
SEQUENCE_RESULT = "name STRING, seq BIGINT, status STRING, first BIGINT, last BIGINT, reserved BIGINT"
RANGE_MAP = "key_space STRING, start_key STRING, end_key STRING, partition_id INT, generation BIGINT"
SET, DELETED = "Set", "Deleted"
EPHEMERAL, PERSISTENT = "E", "P"
