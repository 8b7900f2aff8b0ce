"""One session for all tests.  Plans over few rows are run as they are, as compiling them would take longer."""

import pytest

from tomelattice.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session("tests", cores=4, spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__sql__codegen__wholeStage="false")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
