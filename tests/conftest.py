import pytest

from scriptloom.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "scriptloom-tests",
        master="local[4]",
        shuffle_partitions=4,
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def scripts(spark):
    """Frame of script bodies, keyed in order of appearance."""

    def make(*bodies):
        rows = [(f"f{i:03d}.sql", f"m{i}", body) for i, body in enumerate(bodies)]
        return spark.createDataFrame(
            rows, "sql_file_name string, _stg_sql_file_md5 string, sql_body string"
        )

    return make


@pytest.fixture
def values():
    """Rows of a frame in key order, as tuples of the given columns."""

    def collect(frame, *columns):
        rows = sorted(frame.collect(), key=lambda r: r["sql_file_name"])
        return [tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in rows]

    return collect


@pytest.fixture
def plan():
    """Formatted physical plan of a frame."""

    def explain(frame):
        jvm = frame.sparkSession._jvm
        mode = jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        return frame._jdf.queryExecution().explainString(mode)

    return explain
